"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from zonalis.llm.quality import STOP_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# Shingles are compared as hashes of 128 bits; a component is reached by steps along the links.
OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

# Bytes are taken as pairs of hexadecimal digits.
OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, c, x[2000 * c + 1:2000 * c + 2098] AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2000 + 1)) AS c FROM d)),
p AS (SELECT doc_id, 1000 * c + j AS i, y[2 * j + 1:2 * j + 100] AS s FROM (SELECT *, unnest(range(0, least(1000, len(y) // 2 - 49))) AS j FROM c)),
m AS (SELECT s, min(doc_id) AS first FROM p GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT doc_id, i FROM p JOIN m USING (s) WHERE doc_id > first),
o AS (SELECT doc_id, i, i - max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM g),
b AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z, lag(max(i) + 50, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS last FROM b GROUP BY 1, 2),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail, string_agg(x[2 * last + 1:2 * a], '' ORDER BY run) AS head FROM r JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN x ELSE head || x[2 * tail + 1:] END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP2 = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0 * source_size::DOUBLE AS room, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
v AS (SELECT *, (total - coalesce(sum(room) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT arg_min(level, k) AS level, min(k) AS k FROM v WHERE level * w <= room),
g AS (SELECT v.source, source_size, CASE WHEN f.k IS NULL OR v.k < f.k THEN room ELSE f.level * w END AS target,
        ('0x' || left(md5('mix-1' || coalesce(v.source, '(null)')), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM v, f),
n AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN size < 64 THEN size ELSE (floor(log2(size::DOUBLE))::BIGINT - 5) * 64 + size // pow(2, floor(log2(size::DOUBLE)) - 5)::BIGINT END,
        left(md5(coalesce(doc_id::VARCHAR, '')), 2), doc_id NULLS FIRST, size) - 1 AS i FROM d),
p AS (SELECT n.doc_id, size, source_size, target, u, i, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM n JOIN g ON n.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, ((floor(u + rate * (i + 1)) - floor(u + rate * i)) * size)::BIGINT AS taken FROM p
"""

OP9 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS k
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND k = 1
"""

_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))

OP10 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
t AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS k FROM t),
x AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE k > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0)::BIGINT AS word_chars,
        len(string_split_regex(text, '[#*$%&|<>]')) - 1 AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(ls) AS n_lines, len(list_filter(ws, lambda s: list_contains([{_STOP}], lower(s)))) AS n_stop_words
      FROM w JOIN l USING (r) LEFT JOIN x USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words BETWEEN 50 AND 100000 AND coalesce(n_repeat_words / nullif(n_words, 0) <= 0.5, true)
  AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 2.0 AND 14.0, true) AND coalesce(n_symbols / nullif(n_words, 0) <= 0.2, true)
  AND coalesce(n_stop_words / nullif(n_words, 0) >= 0.005, true) AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.4, true) AS kept
FROM b
"""


def _pii_sql() -> str:
    plain = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
        ("secret", r"[A-Za-z0-9_+/=-]{24,}"),
    ]
    found = " UNION ALL ".join(f"SELECT r, {k} AS ord, '{kind}' AS kind, regexp_extract_all(text, '{rx}') AS ms, text AS t FROM w" for k, (kind, rx) in enumerate(plain))
    pieces = "CASE kind " + " ".join(f"WHEN '{kind}' THEN string_split_regex(t, '{rx}')" for kind, rx in plain) + " END"
    code = "replace(m, ' ', '')"
    mod97 = f"list_reduce([0] || list_transform(string_split({code}[5:] || {code}[1:4], ''), lambda c: ascii(c)), lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"
    octets = "list_reduce(list_transform(string_split(m, '.'), lambda s: (length(ltrim(s, '0')) <= 3 AND coalesce(try_cast(right(s, 3) AS INT), 0) <= 255)::INT), lambda a, b: a * b) = 1"
    before = "translate(t[greatest(pos::BIGINT - 40, 0) + 1:pos::BIGINT], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    luhn = "list_sum(list_transform(range(0, length(d)::BIGINT), lambda j: CASE WHEN j % 2 = 0 THEN d[length(d) - j]::INT WHEN d[length(d) - j]::INT > 4 THEN 2 * d[length(d) - j]::INT - 9 ELSE 2 * d[length(d) - j]::INT END)) % 10 = 0"
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
q AS (SELECT r, ord, kind, ms, t, {pieces} AS ps FROM f WHERE len(ms) > 0),
e AS (SELECT r, ord, kind, t, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d,
        list_sum(list_transform(ps[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda s: length(s))), 0) AS pos
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM q)),
v AS (SELECT r, ord, kind, pos, kind || ':' || pos::BIGINT || ':' || (pos + length(m))::BIGINT AS said FROM e WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN {octets}
        WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND {luhn} WHEN 'iban' THEN length({code}) BETWEEN 15 AND 34 AND {mod97}
        WHEN 'secret' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND regexp_matches({before}, 'token|secret|passw|api|key|auth|bearer|credential') ELSE length(d) BETWEEN 9 AND 15 END),
s AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
        string_agg(said, ',' ORDER BY pos, ord) FILTER (ord < 4) AS base, string_agg(said, ',' ORDER BY pos, ord) AS spans, count(*) AS n_spans FROM v GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM w LEFT JOIN s USING (r)
"""

OP11 = r"""
WITH d AS (SELECT coalesce(text, '') AS text, doc_id, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls FROM documents),
u AS (SELECT *, len(ls) AS n, list_transform(ls, lambda s: length(s)) AS ws, ('0x' || h[1:8])::BIGINT % (len(ls) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(ls) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, coalesce(list_sum(ws[1:least(a, b)]), 0)::BIGINT AS x, coalesce(list_sum(ws[1:greatest(a, b)]), 0)::BIGINT AS y FROM u),
p AS (SELECT *, substring(text, 1, x) AS p, substring(text, x + 1, y - x) AS m, substring(text, y + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

# CRC-32 from its table of 256 remainders, byte by byte. Near words share what is left without one letter, or have one such rest.
OP13 = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || [0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
x AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
h AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || x[2 * i - 1:2 * i])::BIGINT), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM x, t),
w AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
c AS MATERIALIZED (SELECT word, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
e AS (SELECT a.word AS a, b.word AS b FROM c a JOIN c b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word UNION SELECT c.word, w.word FROM c JOIN w ON c.rest = w.word),
m AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
b AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS best, max(n) AS best_n FROM m JOIN w ON b = word GROUP BY 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN b ON word = a),
s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, f2.n) AS root, any_value(f.n) AS n, any_value(f.n_near) AS n_near, any_value(f.form_n) AS form_n
FROM f JOIN s USING (word) JOIN (SELECT word AS root, n FROM f) f2 USING (root) GROUP BY f.word, form
"""


ORACLES = {"op1_ngram_join": OP1, "op3_suffix_dedup": OP3, "op7_mixing": OP7, "op2_exact_dedup": OP2, "op9_url_filters": OP9, "op10_quality_rules": OP10, "op6_pii": _pii_sql(), "op11_fill_in_middle": OP11, "op13_spelling_variants": OP13}
