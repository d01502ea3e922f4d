"""The registered queries of the operators, each over its whole table, and their SQL checks."""

from __future__ import annotations

from barloom.llm import (
    chat_format,
    decontamination,
    html_extraction,
    language_id,
    licence_scan,
    line_dedup,
    merkle_manifest,
    metric_search,
    mixing,
    near_dedup,
    prefix_trie,
    substring_dedup,
    suffix_dedup,
)
from barloom.llm.steps import table

# DuckDB: words as [^\x20\x09-\x0D]+, a null text has none
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def op1_mixing(spark, sf_dir):
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS low FROM p GROUP BY s),
r AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM p JOIN f USING (s) WHERE doc_id > low),
k AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, coalesce(list_aggregate(
  CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j))) END,
  'string_agg', ' '), '') AS kept_text, sha256(kept_text) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
rare AS (SELECT x.doc_id, x.g, row_number() OVER (PARTITION BY x.doc_id ORDER BY c, x.g) AS k
  FROM x JOIN (SELECT g, count(*) AS c FROM x GROUP BY g) USING (g)),
prefix AS (SELECT doc_id, g, n FROM rare JOIN n USING (doc_id) WHERE k <= n - (75 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b USING (g)
  WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
e AS (SELECT a, b FROM c JOIN s l ON l.doc_id = a JOIN s r ON r.doc_id = b
  WHERE 100 * len(list_intersect(l.s, r.s)) >= 75 * (len(l.s) + len(r.s) - len(list_intersect(l.s, r.s)))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, u.b FROM reach JOIN u ON u.a = reach.r)
SELECT doc_id, n AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n"""


def op6_decontamination(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark, sf_dir):
    return html_extraction.report(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


_PARTS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_PARTS} AS w FROM documents), i AS (SELECT item_id, {_PARTS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw USING (s, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def op10_language_id(spark, sf_dir):
    return language_id.report(table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    return chat_format.perspectives(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH m AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
b AS (SELECT m.*, perspective, coalesce(speaker = perspective, false) AS trained,
  CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
  CASE WHEN speaker = perspective OR speaker = 'system' THEN NULL ELSE coalesce(speaker, 'unknown') END AS name FROM m JOIN p USING (conv_id)),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM b),
r AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM h),
s AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER w, 0) AS BIGINT) AS begin, count(*) OVER w AS seq FROM r
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, perspective, turn, seq, role, name, rendered, begin, CASE WHEN trained THEN begin + length(head) END AS trained_from,
  CASE WHEN trained THEN begin + length(rendered) END AS trained_to, trained FROM s"""


def op8_licence_scan(spark, sf_dir):
    return licence_scan.matches(table(spark, sf_dir, "documents"))


_VALUES = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in t) + ")" for t in licence_scan.TEMPLATES)
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
OP8_SQL = f"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT r, doc_id, l, list_filter(range(0, len(l) + 2), lambda i: i = 0 OR i = len(l) + 1 OR trim(l[i], ' ') = '') AS e FROM l),
u AS (SELECT r, doc_id, 'line' AS kind, i - 1 AS line, l[i] AS text FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM e)
  UNION ALL SELECT r, doc_id, 'paragraph', e[k], array_to_string(l[e[k] + 1:e[k + 1] - 1], chr(10))
  FROM (SELECT r, doc_id, l, e, unnest(range(1, len(e))) AS k FROM e) WHERE e[k + 1] - e[k] > 2
  UNION ALL SELECT r, doc_id, 'text', 0, array_to_string(l, chr(10)) FROM e WHERE len(e) > 2),
t AS (SELECT * FROM (VALUES {_VALUES}) AS x(licence, variant, text)),
tg AS (SELECT licence, variant, {_PAIRS} AS g FROM (SELECT licence, variant, {_PARTS} AS w FROM t)),
known AS (SELECT DISTINCT unnest(g) AS p FROM tg),
lw AS (SELECT r, doc_id, kind, line, 0 AS word, {_PARTS} AS w FROM u),
hit AS (SELECT r, doc_id, line, w, i FROM (SELECT r, doc_id, line, w, unnest(range(1, len(w))) AS i FROM lw WHERE kind = 'line') JOIN known ON p = w[i] || ' ' || w[i + 1]),
st AS (SELECT r, any_value(doc_id) AS doc_id, line, min(i) AS s, max(i) AS e, any_value(w) AS w
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, line ORDER BY i) AS island FROM hit) GROUP BY r, line, island),
uw AS (SELECT r, doc_id, kind, line, word, w FROM lw WHERE len(w) >= 2
  UNION ALL SELECT r, doc_id, 'stretch', line, s - 1, w[s:e + 1] FROM st WHERE e - s + 1 >= 3 AND e - s + 1 < len(w) - 1),
ug AS (SELECT r, doc_id, kind, line, word, {_PAIRS} AS g FROM uw),
s AS (SELECT r, doc_id, kind, line, word, licence, variant, 2.0::DOUBLE * len(list_intersect(ug.g, tg.g)) / (len(ug.g) + len(tg.g)) AS dice
  FROM ug JOIN tg ON 3 * len(ug.g) >= 2 * len(tg.g) AND 2 * len(ug.g) <= 3 * len(tg.g))
SELECT doc_id, kind, line, word, licence, variant, dice FROM s WHERE dice >= 0.8
  QUALIFY row_number() OVER (PARTITION BY r, kind, line, word ORDER BY dice DESC, licence, variant) = 1"""


def op9_metric_search(spark, sf_dir):
    return metric_search.top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""

# DuckDB has no CRC-32: the table of the polynomial (a fixed value), then a fold over the bytes of the decimal text
_CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t"""


def _crc(decimal: str) -> str:
    codes = f"list_transform(string_split(CAST({decimal} AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def op11_merkle_manifest(spark, sf_dir):
    return merkle_manifest.report(table(spark, sf_dir, "documents"))


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


_ROW = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_RUNS = "list_transform(range(0, (len(l) + 7) // 8), lambda k: sha256(array_to_string(l[8 * k + 1:8 * k + 8], '')))"
OP11_SQL = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (SELECT doc_id, lang, sha256({_ROW} || {_field("text")}) AS leaf,
  sha256({_ROW} || {_field(f"CASE WHEN {_crc('doc_id')} % 3 = 0 THEN {_LOWER.replace("coalesce(text, '')", 'text')} ELSE text END")}) AS other FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
lv AS (SELECT lang, 0 AS v, list(leaf ORDER BY i) AS l FROM p GROUP BY lang
  UNION ALL SELECT lang, v + 1, {_RUNS} FROM lv WHERE len(l) > 1),
h AS (SELECT lang, max(v) AS h, max_by(l, v)[1] AS subroot FROM lv GROUP BY lang),
g AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gi FROM h),
tv AS (SELECT 0 AS v, list(subroot ORDER BY gi) AS l FROM g HAVING count(*) > 0 UNION ALL SELECT v + 1, {_RUNS} FROM tv WHERE len(l) > 1),
steps AS (SELECT lang, v, 0 AS gi, false AS top, l FROM lv WHERE len(l) > 1
  UNION ALL SELECT lang, h + tv.v, gi, true, l FROM g, tv WHERE len(l) > 1),
f AS (SELECT doc_id, lang, i, leaf, other, 0 AS v, other AS node, '' AS proof FROM p
  UNION ALL SELECT doc_id, f.lang, i // 8, leaf, other, f.v + 1,
    sha256(array_to_string(l[k - k % 8 + 1:k], '') || node || array_to_string(l[k + 2:k - k % 8 + 8], '')),
    proof || array_to_string(l[k - k % 8 + 1:k], '') || array_to_string(l[k + 2:k - k % 8 + 8], '')
  FROM (SELECT f.*, s.l, CASE WHEN s.top THEN gi // CAST(pow(8, f.v - h.h) AS BIGINT) ELSE f.i END AS k
    FROM f JOIN steps s ON s.v = f.v AND s.lang IS NOT DISTINCT FROM f.lang JOIN h ON h.lang IS NOT DISTINCT FROM f.lang) AS f)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM f JOIN h ON h.lang IS NOT DISTINCT FROM f.lang, (SELECT max(v) AS tops, max_by(l, v)[1] AS root FROM tv) WHERE f.v = h.h + tops"""


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH crc AS ({_CRC_TABLE}),
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, sha256(strlen(role) || ':' || role || text) AS e, strlen(text) AS size, turn FROM t),
a AS (SELECT c, list({{'e': e, 'size': size}} ORDER BY turn NULLS FIRST, e) AS own FROM o GROUP BY c),
r AS (SELECT a.c, coalesce(b.own[1:h], []) || a.own[h + 1:] AS s FROM (SELECT c, own, CAST({_crc("c")} % 9 AS BIGINT) AS h FROM a, crc) AS a LEFT JOIN a AS b ON b.c = a.c - a.c % 5),
x AS (SELECT c, len(s) AS n, d, sha256(array_to_string(list_transform(s[1:d], lambda q: q.e), ',')) AS k,
  sha256(array_to_string(list_transform(s[1:d - 1], lambda q: q.e), ',')) AS up, coalesce(s[d].size, 0) AS size
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
g AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, any_value(up) AS up,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM x GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY d, up),
b AS (SELECT v.d, v.k, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((w.n_convs - 1) * w.size) AS saved_tokens
  FROM g AS w JOIN x AS v ON v.c = w.conv_id AND v.d <= w.d LEFT JOIN kids ON kids.d = w.d AND kids.k = w.k GROUP BY v.d, v.k)
SELECT g.conv_id, g.d AS depth, parent.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN b USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN g AS parent ON parent.d = g.d - 1 AND parent.k = g.up"""


def op13_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


_LINE_KEY = f"translate(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER.partition(', ')[2].partition(', ')[2]}"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, i, l[i] AS s FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
k AS (SELECT *, {_LINE_KEY} AS key FROM x),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often USING (key)),
o AS (SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept_text FROM m GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256, kept_text FROM o"""

QUERIES = {
    "op10_language_id": op10_language_id,
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_near_dedup": op4_near_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_licence_scan": op8_licence_scan,
    "op9_metric_search": op9_metric_search,
    "op6_decontamination": op6_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES = {
    "op2_substring_dedup": OP2_SQL,
    "op4_near_dedup": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op8_licence_scan": OP8_SQL,
    "op9_metric_search": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
