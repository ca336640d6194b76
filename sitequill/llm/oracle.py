"""DuckDB SQL for the queries of this folder that SQL can state."""

from __future__ import annotations

from .license_scan import NOTICES, PHRASES, words_of

ORACLE: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE["op1_ngram_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, {_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(w) - 2, 1)),
    lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS gram
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
half AS (
  SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY ALL) r USING (doc_id)"""


def _templates() -> str:
    rows = []
    for t in (*PHRASES, *NOTICES):
        words = [w.decode() for w in words_of(t.text.encode())]
        own = sorted(set(words))
        least = max(1, -(-len(own) * round(1000 * t.share) // 1000))
        rows.append(f"('{t.label}', {t.phrase}, {words!r}, {own!r}, {least}, {max(4, len(words))})")
    return ", ".join(rows)


ORACLE["op2_license_scan"] = rf"""
WITH t(label, phrase, words, own, least, stride) AS (VALUES {_templates()}),
d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base AS (
  SELECT doc_id, label, i AS start FROM (
    SELECT doc_id, label, w, words, unnest(range(0, len(w) - len(words) + 1)) AS i
    FROM d JOIN t ON phrase AND list_has_all(w, words))
  WHERE w[i + 1 : i + len(words)] = words),
found AS (
  SELECT doc_id, label, len(list_intersect(own, w[k * stride + 1 : (k + 2) * stride])) AS c, len(own) AS n, least FROM (
    SELECT *, unnest(range(0, CAST(ceil(len(w) / stride) AS BIGINT))) AS k
    FROM d JOIN t ON NOT phrase AND len(list_intersect(own, w)) >= least)),
labels AS (
  SELECT doc_id, label, CAST(c AS DOUBLE) / n AS share FROM found WHERE c >= least
  UNION ALL SELECT doc_id, label, 1.0 FROM base)
SELECT d.doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word,
  coalesce(b.names, '') AS base_labels, coalesce(l.names, '') AS labels, coalesce(l.score, 0.0) AS score
FROM d LEFT JOIN (
  SELECT doc_id, count(*) AS n, min(start) AS first_word, max(start) AS last_word,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS names FROM base GROUP BY doc_id) b USING (doc_id)
LEFT JOIN (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS names, CAST(max(share) AS DOUBLE) AS score
  FROM labels GROUP BY doc_id) l USING (doc_id)"""

ORACLE["op3_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, payload, array_to_string(list_transform(range(1, 41),
    lambda i: lpad(bin(instr('123456789abcdef', hex[i])), 4, '0')), '') AS b FROM p),
named AS (
  SELECT page_id, payload, array_to_string(list_transform(range(0, 32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6),
      lambda j: CAST(b[5 * i + j] AS INT) * CAST(power(2, 5 - j) AS INT))) AS INT), 1)), '') AS digest FROM bits)
SELECT page_id, strlen(payload) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM named)"""

ORACLE["op4_cover_tree"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY ALL) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY ALL) USING (vec_id)"""

ORACLE["op5_chat_collapse"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
pre AS (
  SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS ends,
    list({'turn': turn, 'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn) AS said FROM t),
whole AS (SELECT said, min(conv_id) AS conv_id, count(*) AS copies FROM pre WHERE ends GROUP BY said)
SELECT conv_id, CAST(0 AS BIGINT) AS part, len(said) AS n_turns, copies,
  array_to_string(list_transform(said, lambda x: '<|im_start|>' || replace(lower(trim(x.role)), '<|', '< |')
    || chr(10) || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM whole WHERE said NOT IN (SELECT said FROM pre WHERE NOT ends)"""

ORACLE["op10_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY ALL),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR 100 * n_stutters > 30 * n_words OR 100 * n_upper > 40 * word_chars
    OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words) AS kept
FROM f"""


def _crc32(text: str) -> str:
    """Checksum of a string, bit by bit from its bytes in hexadecimal."""
    digits = f"hex(encode({text}))"
    bits = (
        f"list_transform(range(0, 4 * length({digits})), lambda t: "
        f"(instr('123456789ABCDEF', {digits}[2 * (t // 8) + CASE WHEN t % 8 < 4 THEN 2 ELSE 1 END]) >> (t % 4)) & 1)"
    )
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}), "
        "lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    )


ORACLE["op12_spelling"] = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, '{_UPPER}', '{_LOWER}') AS r, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents)
  WHERE length(r) >= 5 GROUP BY ALL),
h AS (SELECT *, {_crc32("doc_id || ':' || r")} AS h FROM runs),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN r[1 : h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY ALL HAVING sum(n) >= 3),
less AS (
  SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM v)),
pairs AS (
  SELECT x.word AS a, x.n AS an, y.word AS b, y.n AS bn FROM less x JOIN less y USING (i, rest) WHERE x.word <> y.word
  UNION SELECT x.word, x.n, v.word, v.n FROM less x JOIN v ON x.rest = v.word
  UNION SELECT v.word, v.n, x.word, x.n FROM less x JOIN v ON x.rest = v.word),
best AS (
  SELECT a, any_value(an) AS an, count(*) AS n_near, first(b ORDER BY bn DESC, encode(b)) AS b, max(bn) AS bn FROM pairs GROUP BY a),
f AS (
  SELECT word, CASE WHEN bn >= 2 * n THEN b END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN bn >= 2 * n THEN bn END AS form_n FROM v LEFT JOIN best ON word = a),
path(word, last) AS (
  SELECT word, word FROM f UNION ALL SELECT p.word, f.form FROM path p JOIN f ON p.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.last AS root, f.n, f.n_near, f.form_n
FROM f JOIN path p ON p.word = f.word JOIN f z ON z.word = p.last AND z.form IS NULL"""

ORACLE["op13_conversation_trie"] = rf"""
WITH t AS (
  SELECT conv_id AS c, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(said ORDER BY turn NULLS FIRST, said) AS said FROM t GROUP BY c),
h AS (SELECT c, said, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM o),
r AS (SELECT h.c, list_concat(coalesce(b.said[1 : h], []), h.said[h + 1 :]) AS said FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
p AS (SELECT c, d, said[1 : d] AS node, len(said) = d AS ends FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM r)),
n AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids,
    CASE WHEN d > 0 THEN len(regexp_extract_all(node[d].text, {_WORD})) ELSE 0 END AS words
  FROM p GROUP BY node, d),
k AS (SELECT node[1 : d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
nk AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, d)),
s AS (
  SELECT node[1 : e] AS node, e AS d, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM nk) GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM nk x JOIN s USING (node, d) LEFT JOIN nk u ON x.d > 0 AND u.d = x.d - 1 AND u.node = x.node[1 : x.d - 1]"""
