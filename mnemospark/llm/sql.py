"""SQL for DuckDB that gives the rows of those queries that SQL can express.

Plain forms: all shingles, all 50-byte strings and all blocks of words are joined as they are, which small tables allow.
"""

from __future__ import annotations

import math

from . import licenses, mixing

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_LICENSE_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _list(values: list[bytes]) -> str:
    return "[" + ", ".join(f"'{v.decode()}'" for v in values) + "]"


def license_scan() -> str:
    phrases = ", ".join(f"({_list(licenses.words(p))}, '{label}')" for p, label in licenses.PHRASES.items())
    sets = {label: sorted(set(licenses.words(t))) for label, t in licenses.TEMPLATES.items()}
    templates = ", ".join(f"('{label}', {_list(s)}, {math.ceil(licenses.CONTAINMENT * len(s) - 1e-9)})" for label, s in sets.items())
    return f"""WITH phrases(p, label) AS (VALUES {phrases}), templates(label, tokens, needed) AS (VALUES {templates}),
d AS MATERIALIZED (SELECT doc_id, {_LOWER} AS t, regexp_extract_all({_LOWER}, {_LICENSE_WORD}) AS w FROM documents),
places AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN phrases ON w[i] = p[1] AND list_slice(w, i, i + len(p) - 1) = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(list_slice(w, i + 1, i + {licenses.BLOCK})) AS tokens FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {licenses.BLOCK - licenses.STEP}, 1), {licenses.STEP})) AS i FROM d)),
held AS (SELECT doc_id, t.label, len(list_intersect(l.tokens, t.tokens)) AS n, len(t.tokens) AS m, needed FROM blocks l, templates t WHERE len(l.tokens) >= needed),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n / m) AS containment FROM held WHERE n >= needed GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


def ngram_jaccard(k: int = 3, num: int = 90, den: int = 100) -> str:
    gram = " || ' ' || ".join(f"w[i + {n}]" for n in range(k))
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k}) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {k - 1}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE {den} * shared >= {num} * (p.n + q.n - shared)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b FROM r JOIN links ON o = a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def suffix_dedup(size: int = 50) -> str:
    return f"""WITH h AS MATERIALIZED (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5_number(substring(x, 2 * i + 1, {2 * size})) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {size - 1})) AS i FROM h)),
f AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
m AS (SELECT g.doc_id, i FROM g JOIN f USING (k) WHERE d < g.doc_id),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {size} THEN 0 ELSE 1 END AS fresh FROM m)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {size} AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM spans),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substring(any_value(x), 2 * max(b) + 1) AS kept FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)"""


def ranked_search(k: int = 20) -> str:
    word = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {word}) AS w FROM documents),
s AS MATERIALIZED (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
p AS MATERIALIZED (SELECT r, doc_id, t, n, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
q AS (SELECT item_id, i, unnest(regexp_extract_all({_LOWER}, {word})) AS t FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))),
c AS (SELECT item_id, i, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score FROM q JOIN f USING (t) JOIN p USING (t), s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= {k}"""


def source_mixing() -> str:
    weights = "[" + ", ".join(f"{w}::DOUBLE" for w in mixing.WEIGHTS) + "]"
    p = "greatest(least(rest * sqrt(size * n_docs / source_size), 0.999999::DOUBLE), 0.000001::DOUBLE)"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_SPACED}))::BIGINT AS size, (('0x' || substring(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE AS u FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k FROM s0),
s2 AS (SELECT *, {weights}[k % {len(mixing.WEIGHTS)} + 1] AS w, {mixing.MOST} * source_size AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM s2 WINDOW before AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, CASE WHEN cap <= level * w THEN cap::DOUBLE ELSE w * (SELECT arg_min(level, (cap / w, k)) FROM s3 WHERE NOT cap <= level * w) END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS fraction FROM s4),
s6 AS MATERIALIZED (SELECT source AS s, source_size, n_docs, target, floor(fraction + 1e-12::DOUBLE) AS certain, greatest(fraction - floor(fraction + 1e-12::DOUBLE), 0) AS rest, greatest(fraction - floor(fraction + 1e-12::DOUBLE), 0) * source_size AS budget FROM s5),
q AS MATERIALIZED (SELECT *, CASE WHEN size > 0 THEN (u / (1 - u)) / ({p} / (1 - {p})) END AS q FROM d JOIN s6 ON source IS NOT DISTINCT FROM s),
run AS MATERIALIZED (SELECT *, CASE WHEN size > 0 AND rest > 0 THEN sum(CASE WHEN size > 0 AND rest > 0 THEN size ELSE 0 END) OVER (PARTITION BY s ORDER BY q RANGE UNBOUNDED PRECEDING) END AS upto FROM q),
gap AS (SELECT s, any_value(budget) - coalesce(max(upto) FILTER (upto <= budget), 0) AS gap FROM run GROUP BY s HAVING max(upto) > any_value(budget)),
fill AS (SELECT run.s, arg_min(q, (abs(size - gap), q)) AS fq FROM run JOIN gap ON run.s IS NOT DISTINCT FROM gap.s WHERE size > 0 AND NOT coalesce(upto <= budget, false) AND abs(size - gap) < gap GROUP BY run.s)
SELECT doc_id, size, source_size, target, ((certain + CASE WHEN size > 0 AND (coalesce(upto <= budget, false) OR coalesce(q = fq, false)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM run LEFT JOIN fill ON run.s IS NOT DISTINCT FROM fill.s"""


ORACLE_SQL = {
    "op2_license_scan": license_scan(),
    "op6_ngram_jaccard": ngram_jaccard(),
    "op9_suffix_dedup": suffix_dedup(),
    "op10_source_mixing": source_mixing(),
    "op12_ranked_search": ranked_search(),
}
