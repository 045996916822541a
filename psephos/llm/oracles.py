"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
LOWER = "'abcdefghijklmnopqrstuvwxyz'"
PLAIN_WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {PLAIN_WORD}) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 5 THEN range(1, len(ws) - 3) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, {PLAIN_WORD}) AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(CASE WHEN len(ws) >= 8 THEN range(1, len(ws) - 6) ELSE [] END) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS k FROM twice) GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT r, line, trim(regexp_replace(translate(line, {UPPER}, {LOWER}), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal FROM raw),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE normal <> '' GROUP BY r),
common AS (SELECT host, normal FROM lines JOIN d USING (r) WHERE normal <> '' GROUP BY host, normal HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) > 20),
lost AS (
  SELECT r, sum(len(string_split(l.normal, ' '))) AS n FROM lines l JOIN d USING (r) JOIN common c ON c.host = d.host AND c.normal = l.normal GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_boilerplate_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * (n_words - n_boilerplate_words) < 33 * n_words) AS kept, n_boilerplate_words
FROM b
"""

OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT item, ws, least(len(ws), 10) AS m, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE range(1, len(ws) - least(len(ws), 10) + 2) END) AS i FROM b)),
dw AS (
  SELECT r, i, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT r, ws, m, unnest(CASE WHEN len(ws) >= m THEN range(1, len(ws) - m + 2) ELSE [] END) AS i FROM d, (SELECT DISTINCT m FROM bw))),
h AS (SELECT r, i, dw.m, item FROM dw JOIN bw ON bw.m = dw.m AND bw.g = dw.g),
n AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, m)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {PLAIN_WORD}) AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 20 THEN range(1, len(ws) - 18) ELSE [] END) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM later)),
kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.i) AS kept
  FROM (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)) w
  LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i WHERE gone.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(role) + length(text) + len(regexp_extract_all(text,
    '<\\*(\|turn\||\|text\||\|end\||s|/s|<SYS>|</SYS>|\|im_start\||\|im_end\||\|endoftext\||\|system\||\|user\||\|assistant\|)>|\[\\*/?INST\]'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP11 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT r, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS x, b.r AS y, a.vec_id AS i, b.vec_id AS j FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
t AS (SELECT vec_id AS i, vec_id AS j FROM v UNION SELECT t.i, l.j FROM t JOIN l ON t.j = l.i),
c AS (SELECT i, min(j) AS component_id FROM t GROUP BY i)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v LEFT JOIN n ON n.x = v.r LEFT JOIN c ON c.i = v.vec_id
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p, v FROM m JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM m GROUP BY ALL) JOIN v USING (lang)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: The remainder of crc32 by 2, bit by bit.
_ODD = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))) & 1"


def _levels(name: str, key: str, leaves: str) -> str:
    """A tree of arity three over the leaves (key, i, h) of each key, level by level."""
    return f"""{name} AS (
  SELECT {key}, 0 AS level, i, h, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves}
  UNION ALL SELECT {key}, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {key}, level, n, i // 3)"""


OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS s, {_leaf('text')} AS leaf, CASE WHEN 1 - ({_ODD}) = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS other FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d),
{_levels('t', 's', 'l')},
sub AS (SELECT s, h AS subroot FROM t WHERE n = 1),
tops AS (SELECT 0 AS one, s, row_number() OVER (ORDER BY s) - 1 AS i, subroot AS h FROM sub),
{_levels('u', 'one', 'tops')},
root AS (SELECT h AS root FROM u WHERE n = 1),
nodes AS (SELECT 'leaf' AS kind, s, level, i, h FROM t UNION ALL SELECT 'top', NULL, level, i, h FROM u),
steps AS (
  SELECT l.doc_id, l.s, l.i AS place, 'leaf' AS kind, level, l.i // CAST(pow(3, level) AS BIGINT) AS k, level AS step FROM l JOIN (SELECT DISTINCT s, level FROM t WHERE n > 1) USING (s)
  UNION ALL SELECT l.doc_id, l.s, l.i, 'top', level, tops.i // CAST(pow(3, level) AS BIGINT), 1000 + level FROM l JOIN tops USING (s), (SELECT DISTINCT level FROM u WHERE n > 1)),
sides AS (
  SELECT x.s, x.place, row_number() OVER (PARTITION BY x.s, x.place ORDER BY step) AS step, before, after FROM steps x LEFT JOIN LATERAL (
    SELECT coalesce(string_agg(h, '' ORDER BY y.i) FILTER (y.i < x.k), '') AS before, coalesce(string_agg(h, '' ORDER BY y.i) FILTER (y.i > x.k), '') AS after
    FROM nodes y WHERE y.kind = x.kind AND y.s IS NOT DISTINCT FROM CASE WHEN x.kind = 'leaf' THEN x.s END AND y.level = x.level AND y.i // 3 = x.k // 3) ON true),
proof AS (SELECT s, place, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM sides GROUP BY s, place),
fold AS (
  SELECT s, i AS place, 0 AS step, coalesce(other, leaf) AS h FROM l
  UNION ALL SELECT f.s, f.place, x.step, sha256(before || h || after) FROM fold f JOIN sides x ON x.s = f.s AND x.place = f.place AND x.step = f.step + 1),
last AS (SELECT s, place, arg_max(h, step) AS folded FROM fold GROUP BY s, place)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM l JOIN sub USING (s), root JOIN last ON last.s = l.s AND last.place = l.i LEFT JOIN proof ON proof.s = l.s AND proof.place = l.i
"""

SQL: dict[str, str] = {
    "op1_near_duplicates": OP1,
    "op2_line_quality": OP2,
    "op3_contamination": OP3,
    "op6_substrings": OP6,
    "op8_chat": OP8,
    "op11_embedding_duplicates": OP11,
    "op12_source_divergence": OP12,
    "op13_merkle_manifest": OP13,
}
