"""The queries of the subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from parlance.llm import queries as q

QUERIES = {
    f.__name__: f
    for f in (q.p1_found, q.p3_found, q.p3_classes, q.p4_found, q.p4_redacted, q.p5_found, q.p7_found, q.p8_containers, q.p9_found, q.p9_edited, q.p10_found)
}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _runs(table: str, key: str, words: str, n: int, least: int) -> str:
    """SQL of the distinct runs of n words of every text with at least `least`."""
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= {least}"


#: Resolved paths: / for \\, and without `.`, `..` and doubled / (parts are folded from the left).
_PATH = r"""CASE WHEN trim(coalesce(file_path, '')) = '' THEN NULL ELSE (CASE WHEN starts_with(replace(file_path, '\', '/'), '/') THEN '/' ELSE '' END) || array_to_string(list_reduce(list_prepend([]::VARCHAR[],
  list_transform(list_filter(string_split(replace(file_path, '\', '/'), '/'), lambda x: x NOT IN ('', '.')), lambda x: [x])), lambda a, x: CASE WHEN x[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:len(a) - 1] WHEN x[1] = '..' AND starts_with(replace(file_path, '\', '/'), '/') THEN a ELSE list_concat(a, x) END), '/') END"""

SQL: dict[str, str] = {
    "p7_found": f"""
WITH RECURSIVE i AS (SELECT batch_no, item_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s, {_PATH} AS path, row_number() OVER (ORDER BY batch_no, item_id) AS rn FROM prompt_batches),
f AS (SELECT DISTINCT {_PATH} AS path FROM processed_sessions), b AS (SELECT path, min(batch_no) AS b FROM i WHERE path IS NOT NULL GROUP BY path),
h AS (SELECT DISTINCT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM prompts WHERE text IS NOT NULL),
gi AS ({_runs("prompt_batches", "item_id", _WORDS, 3, 20)}), gp AS ({_runs("prompts", "id", _WORDS, 3, 20)}), ni AS (SELECT item_id, count(*) AS n FROM gi GROUP BY item_id), np AS (SELECT id, count(*) AS n FROM gp GROUP BY id),
ch AS (SELECT item_id, id, count(*) AS c FROM gi JOIN gp USING (g) GROUP BY 1, 2), nh AS (SELECT DISTINCT item_id FROM ch JOIN ni USING (item_id) JOIN np USING (id) WHERE c * 10 >= 6 * (ni.n + np.n - c)),
ci AS (SELECT x.item_id AS a, y.item_id AS e, count(*) AS c FROM gi x JOIN gi y ON x.g = y.g AND x.item_id <> y.item_id GROUP BY 1, 2), ns AS (SELECT a, e FROM ci JOIN ni x ON x.item_id = a JOIN ni y ON y.item_id = e WHERE c * 10 >= 6 * (x.n + y.n - c)),
k AS (SELECT i.*, coalesce(b.b < i.batch_no, false) OR f.path IS NOT NULL AS file, h.s IS NOT NULL AS copied, nh.item_id IS NOT NULL AS close FROM i LEFT JOIN b ON b.path = i.path LEFT JOIN f ON f.path = i.path LEFT JOIN h ON h.s = i.s LEFT JOIN nh ON nh.item_id = i.item_id),
e AS (SELECT x.rn, list(y.rn) AS earlier FROM i x JOIN i y ON y.rn < x.rn AND x.s = y.s GROUP BY x.rn), n AS (SELECT x.rn, list(y.rn) AS earlier FROM ns JOIN i x ON x.item_id = ns.a JOIN i y ON y.item_id = ns.e AND y.rn < x.rn GROUP BY x.rn),
r AS (SELECT k.*, coalesce(e.earlier, []) AS same, coalesce(n.earlier, []) AS near FROM k LEFT JOIN e USING (rn) LEFT JOIN n USING (rn)),
t AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept, NULL::BIGINT AS batch_no, NULL::BIGINT AS item_id, NULL::VARCHAR AS verdict UNION ALL
  SELECT r.rn, CASE WHEN NOT file AND NOT copied AND NOT list_has_any(kept, same) AND NOT close AND NOT list_has_any(kept, near) THEN list_append(kept, r.rn) ELSE kept END, r.batch_no, r.item_id,
  CASE WHEN file THEN 'file' WHEN copied OR list_has_any(kept, same) THEN 'exact' WHEN close OR list_has_any(kept, near) THEN 'near' END FROM t JOIN r ON r.rn = t.rn + 1)
SELECT batch_no, item_id, verdict FROM t WHERE verdict IS NOT NULL""",
    "p3_found": f"""
WITH s AS ({_runs("prompts", "id", _WORDS, 3, 20)}), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c * 10 >= 6 * (x.n + y.n - c)""",
    "p9_found": f"""
WITH d AS ({_runs("documents", "doc_id", _WORDS, 10, 10)}), i AS ({_runs("eval_items", "item_id", _WORDS, 10, 10)})
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)""",
    "p10_found": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, unnest(range(1, len(w) - 38)) AS i, w FROM w WHERE len(w) >= 40), h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 39], ' ')) AS g FROM r),
s AS (SELECT g FROM h GROUP BY g HAVING min(doc_id) <> max(doc_id)), m AS (SELECT DISTINCT doc_id, i FROM h SEMI JOIN s USING (g)),
n AS (SELECT doc_id, least(40, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 40)) AS k FROM m) SELECT doc_id, CAST(sum(k) AS BIGINT) AS shared_words FROM n GROUP BY doc_id""",
    "p3_classes": f"""
WITH s AS ({_runs("prompts", "id", _WORDS, 5, 20)}), k AS (SELECT id, md5(string_agg(g, '|' ORDER BY g)) AS k, count(*) AS n FROM s GROUP BY id), r AS (SELECT k, min(id) AS class_id, count(*) AS n_copies, max(n) AS n FROM k GROUP BY k),
t AS (SELECT s.id, g FROM s JOIN r ON s.id = r.class_id), c AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN r p ON p.class_id = x JOIN r q ON q.class_id = y WHERE c * 10 >= 8 * (p.n + q.n - c)), l AS (SELECT v, count(*) AS n FROM (SELECT x AS v FROM e UNION ALL SELECT y FROM e) GROUP BY v)
SELECT id, class_id, n_copies, coalesce(l.n, 0) AS n_links FROM k JOIN r USING (k) LEFT JOIN l ON l.v = class_id""",
    "p1_found": r"""
WITH RECURSIVE cx AS (SELECT conversation_id AS conv, mapping FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY cardinality(mapping) DESC, rec_id) AS n FROM chatgpt_conversations WHERE mapping IS NOT NULL) WHERE n = 1),
ce AS (SELECT conv, unnest(map_entries(mapping)) AS e FROM cx),
cn AS (SELECT conv, e.key AS k, nullif(e.value.parent, '') AS parent, coalesce(e.value.children, []) AS children, lower(trim(e.value.message.author.role)) AS role,
  len(list_filter(coalesce(e.value.message.content.parts, []), lambda p: regexp_matches(p, '\S') AND NOT (ltrim(p) LIKE '{%' AND json_extract_string(CASE WHEN json_valid(p) THEN p END, '$.content_type') IS NOT NULL))) > 0 AS said FROM ce),
ck AS (SELECT conv, list(k) AS ks FROM cn GROUP BY conv),
cb AS (SELECT conv FROM cn JOIN ck USING (conv) GROUP BY conv HAVING count(*) FILTER (parent IS NULL) <> 1 OR bool_or(parent IS NOT NULL AND NOT list_contains(ks, parent)) OR bool_or(NOT list_has_all(ks, children))),
walk AS (SELECT conv, k, 0 AS pos, [k] AS path, false AS back FROM cn ANTI JOIN cb USING (conv) WHERE parent IS NULL
  UNION ALL SELECT w.conv, n.children[-1], w.pos + 1, list_append(w.path, n.children[-1]), list_contains(w.path, n.children[-1]) FROM walk w JOIN cn n ON n.conv = w.conv AND n.k = w.k WHERE NOT w.back AND len(n.children) > 0),
ct AS (SELECT 'chatgpt_conversations' AS tbl, w.conv, w.pos, w.k, CASE WHEN n.role = 'human' THEN 'user' ELSE n.role END AS role FROM walk w JOIN cn n ON n.conv = w.conv AND n.k = w.k
  WHERE n.said AND n.role IN ('user', 'human', 'assistant') AND w.conv NOT IN (SELECT conv FROM walk WHERE back)),
ax AS (SELECT uuid AS conv, chat_messages FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY len(list_distinct(list_transform(chat_messages, lambda m: m.uuid))) DESC, rec_id) AS n FROM claude_chat_export WHERE chat_messages IS NOT NULL) WHERE n = 1),
am AS (SELECT conv, unnest(chat_messages) AS m FROM ax),
an AS (SELECT conv, m.uuid AS k, any_value(m.index) AS pos, any_value(lower(trim(m.sender))) AS role,
  bool_or(regexp_matches(coalesce(m.text, ''), '\S') OR len(list_filter(coalesce(m.content, []), lambda c: c.type = 'text' AND regexp_matches(coalesce(c.text, ''), '\S'))) > 0) AS said FROM am GROUP BY conv, m.uuid),
ab AS (SELECT conv FROM an GROUP BY conv HAVING count(DISTINCT pos) <> count(*) OR min(pos) <> 0 OR max(pos) <> count(*) - 1 OR bool_or(coalesce(role, '') NOT IN ('user', 'human', 'assistant'))),
pos AS (SELECT 'claude_chat_export' AS tbl, conv, pos, k, CASE WHEN role = 'human' THEN 'user' ELSE role END AS role FROM an ANTI JOIN ab USING (conv) WHERE said),
sr AS (SELECT session_id AS conv, uuid AS k, rec_id, epoch_us(TRY_CAST(timestamp AS TIMESTAMPTZ)) AS us, nullif(lower(trim(message.role)), '') AS role, message.content AS c FROM claude_session WHERE type IN ('user', 'assistant')),
sb AS (SELECT DISTINCT conv FROM sr WHERE us IS NULL OR role IS NULL),
ss AS (SELECT conv, k, min(us) AS us, min(rec_id) AS rec_id, any_value(role) AS role FROM sr ANTI JOIN sb USING (conv) WHERE role IN ('user', 'human', 'assistant') AND CASE WHEN ltrim(c) LIKE '[%' AND json_valid(c)
  THEN len(list_filter(json_extract(CASE WHEN json_valid(c) THEN c END, '$[*]'), lambda b: json_extract_string(b, '$.type') = 'text' AND regexp_matches(coalesce(json_extract_string(b, '$.text'), ''), '\S'))) > 0 ELSE regexp_matches(coalesce(c, ''), '\S') END GROUP BY conv, k),
st AS (SELECT 'claude_session' AS tbl, conv, row_number() OVER (PARTITION BY conv ORDER BY us, rec_id) AS pos, k, CASE WHEN role = 'human' THEN 'user' ELSE role END AS role FROM ss),
t AS (SELECT * FROM ct UNION ALL SELECT * FROM pos UNION ALL SELECT * FROM st),
o AS (SELECT tbl, conv, k, role, row_number() OVER w - 1 AS turn_no, lead(role) OVER w AS next FROM t WINDOW w AS (PARTITION BY tbl, conv ORDER BY pos)),
bad AS (SELECT DISTINCT tbl, conv FROM o WHERE (turn_no = 0 AND role <> 'user') OR (role = 'user' AND coalesce(next, '') <> 'assistant'))
SELECT tbl, conv AS conv_key, turn_no, k AS msg_key, role FROM o ANTI JOIN bad USING (tbl, conv)""",
}
