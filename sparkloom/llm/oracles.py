"""DuckDB SQL that gives the same rows as the queries that plain SQL can express."""

from __future__ import annotations

from .license_scan import BLOCK, CONTAINMENT, NOTICES, PHRASES
from .merkle_manifest import ORACLE as MERKLE_MANIFEST
from .quality_rules import oracle as quality_rules
from .template_dedup import oracle as template_dedup

WORDS = "list_filter(string_split_regex({}, '[\\x09-\\x0D ]+'), lambda x: x <> '')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUFFIX_AUTOMATON = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format('text')}, []) AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM p),
earliest AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
gone AS (SELECT DISTINCT doc_id, ln FROM (SELECT w.doc_id, unnest(range(i, i + 50)) AS ln FROM w JOIN earliest USING (h) WHERE first < w.doc_id)),
all_words AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS ln, unnest(words) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY ln) AS kept, count(*) AS n FROM all_words a ANTI JOIN gone USING (doc_id, ln) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

CAP_FILTERS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)"""

BOTTOM_K = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({WORDS.format(LOWER)}, []) AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

SUFFIX_ARRAY = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, octet_length(h) - 199)) AS i FROM d WHERE octet_length(h) >= 200),
w AS (SELECT doc_id, i, md5(array_slice(h, i + 1, i + 200)) AS k FROM p),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN r USING (k)),
s AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
c AS (SELECT doc_id, island, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY ALL),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS done FROM c),
k AS (SELECT doc_id, string_agg(CASE WHEN a > done THEN hex(array_slice(h, done + 1, a)) ELSE '' END, '' ORDER BY a) AS head, max(b) AS stop, count(*) AS n, sum(b - a) AS gone FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || CASE WHEN octet_length(h) > coalesce(stop, 0) THEN hex(array_slice(h, coalesce(stop, 0) + 1, octet_length(h))) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


def license_scan() -> str:
    """Every place of every phrase, and every block of every notice, without filters."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    notices = ", ".join(f"('{label}', {quoted(sorted(set(text.split())))}, {max(BLOCK, 2 * len(text.split()))})" for label, text in NOTICES.items())
    phrases = ", ".join(f"('{label}', {quoted(text.split())})" for text, label in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.replace('(text,', "(coalesce(text, ''),")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(label, words) AS (VALUES {phrases}),
n(label, words, size) AS (VALUES {notices}),
places AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(words) + 2), lambda i: w[i:i + len(words) - 1] = words)) AS i FROM d, p),
blocks AS (SELECT doc_id, label, words, list_slice(w, s + 1, s + size) AS block FROM (SELECT doc_id, label, words, size, w, unnest(range(0, len(w), size // 2)) AS s FROM d, n)),
met AS (SELECT doc_id, label, len(list_intersect(list_distinct(block), words)) AS held, len(words) AS n FROM blocks),
found AS (SELECT doc_id, label, held / n AS share FROM met WHERE held >= greatest(1, ceil({CONTAINMENT} * n - 1e-9))),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT doc_id, label, 1.0 AS share FROM places UNION ALL SELECT * FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""


ORACLES = {
    "op1_license_scan": license_scan(),
    "op5_suffix_array_dedup": SUFFIX_ARRAY,
    "op2_template_dedup": template_dedup(),
    "op7_suffix_automaton_dedup": SUFFIX_AUTOMATON,
    "op9_cap_filter_dedup": CAP_FILTERS,
    "op10_bottom_k_dedup": BOTTOM_K,
    "op12_merkle_manifest": MERKLE_MANIFEST,
    "op13_quality_rules": quality_rules(),
}
