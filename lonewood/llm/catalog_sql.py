"""DuckDB SQL twins of the registered queries that SQL can express.

The others need a tokenizer, a 64-bit hash that SQL lacks, an HTML parser or a trained
model; the tests hold those against brute force.
"""

from __future__ import annotations

from .quality import MAX_CLASS_DISTANCE, MAX_COMMON_CHARS, MIN_CHARS, MIN_WORDS, N_COMMON, WINDOW, WORD_MARGIN, WORD_SHARE

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, w[i:i + 9] AS g FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.i, s.n, g.item FROM s JOIN g USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP5 = """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, payload_digest, CASE WHEN d.page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of the count lists ``p`` and ``q``."""
    a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    part = lambda x, y: f"(CASE WHEN {x} > 0 THEN {x} * log2(2.0 * {x} / ({x} + {y})) ELSE 0.0 END)"
    return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(a, b)} + {part(b, a)}) / 2))))"


_CLASSES = "[{}, CAST(length(t) AS DOUBLE) - {}, {}]".format(
    ", ".join(f"CAST(length(regexp_replace(t, '{c}', '', 'g')) AS DOUBLE)" for c in (r"[^a-z]", r"[^A-Z]", r"[^0-9]", r"[^\x20\x09-\x0D]")),
    " - ".join(f"length(regexp_replace(t, '{c}', '', 'g'))" for c in (r"[^a-z]", r"[^A-Z]", r"[^0-9]", r"[^\x20\x09-\x0D]", r"[\x00-\x7F]")),
    r"CAST(length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS DOUBLE)")

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, {_CLASSES} AS c FROM d),
y AS (SELECT DISTINCT ON (lang, t) lang, w, c FROM x),
e AS (SELECT lang, unnest(w) AS w FROM y),
n AS (SELECT lang, w, count(*) AS n FROM e GROUP BY 1, 2),
k AS (SELECT lang, list(w ORDER BY n DESC, w) AS words, list(CAST(n AS DOUBLE) ORDER BY n DESC, w) AS ns FROM
  (SELECT * FROM n WHERE length(w) <= {MAX_COMMON_CHARS} QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {N_COMMON}) GROUP BY 1),
r AS (SELECT k.lang, k.words, list_append(k.ns, a.n - list_sum(k.ns)) AS q FROM k JOIN (SELECT lang, CAST(sum(n) AS DOUBLE) AS n FROM n GROUP BY 1) a USING (lang)),
rc AS (SELECT lang, [sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5]), sum(c[6])] AS q FROM y GROUP BY 1),
g AS (SELECT rid, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM x WHERE len(w) >= {WINDOW})),
u AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
v AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM u) GROUP BY 1),
o AS (SELECT x.*, r.words, r.q AS rq, rc.q AS cq, list_transform(r.words, lambda y: CAST(len(list_filter(x.w, lambda z: z = y)) AS DOUBLE)) AS p,
  coalesce(v.n, 0) AS n_repeat_words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM x JOIN rc USING (lang) LEFT JOIN r USING (lang) LEFT JOIN v USING (rid)),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - c[4] AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  len(w) < 10 OR 100 * n_repeat_words > 20 * len(w) AS base_failed,
  CASE WHEN length(t) >= {MIN_CHARS} THEN {_js("c", "cq")} END AS cd,
  CASE WHEN len(w) >= {MIN_WORDS} THEN {_js("pp", "rq")} END AS wd,
  CASE WHEN len(w) >= {MIN_WORDS} THEN {WORD_SHARE} * {_js("none", "rq")} + {WORD_MARGIN} / sqrt(len(w)) END AS far
  FROM (SELECT *, list_append(p, len(w) - list_sum(p)) AS pp, list_append(list_transform(p, lambda v: CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS none FROM o))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
  NOT base_failed AND coalesce(cd <= {MAX_CLASS_DISTANCE}, true) AND coalesce(wd <= far, true) AS kept
FROM m
"""

OP12 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM d),
c AS MATERIALIZED (SELECT s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT id, n, unnest(s) AS x FROM c),
i AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * k >= 80 * (na + nb - k)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS root FROM c UNION SELECT u.b, r.root FROM r JOIN u ON r.id = u.a WHERE r.root < u.b),
m AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, coalesce(m.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON m.id = c.id
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || x[k:k + 7] AS BIGINT)) AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""

ORACLE: dict[str, str] = {"op2_postings_decontamination": OP2, "op5_warc_roundtrip": OP5, "op7_quality_divergence": OP7, "op12_minhash_components": OP12, "op13_fill_in_middle": OP13}
