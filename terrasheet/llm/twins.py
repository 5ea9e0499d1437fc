"""SQL twins of the queries that SQL can express on whole tables, for another engine to run."""

from __future__ import annotations

from .license_scan import TEMPLATES, THRESHOLD, template_bigrams, template_words

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SPACED = f"regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS MATERIALIZED (SELECT doc_id, dw.m, k, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) GROUP BY 1),
own AS (SELECT doc_id, count(item) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, coalesce(own.s, sha256('')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN own ON d.doc_id = own.doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to FROM q"""

NEAR = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {SPACED} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS least FROM w UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.node WHERE r.least < l.b),
m AS (SELECT node, min(least) AS least FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least AS component_id, least = w.doc_id AS kept FROM w JOIN m ON m.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""


def _licences() -> str:
    known = {k: v for k, v in sorted(TEMPLATES.items())}
    rows = ", ".join(f"('{k}', [{', '.join(repr(b) for b in template_bigrams(v))}], {len(template_words(v))})" for k, v in known.items())
    words = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda v: v <> '')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH t(id, b, m) AS (VALUES {rows}),
x AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS x, {words.format("coalesce(text, '')")} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) > 1 THEN list_append(l, x) ELSE l END)) AS s FROM (SELECT doc_id, x, string_split(x, chr(10)) AS l FROM x)),
g AS MATERIALIZED (SELECT doc_id, s, {pairs.format("w")} AS b FROM (SELECT doc_id, s, {words.format("s")} AS w FROM s WHERE s <> '')),
k AS MATERIALIZED (SELECT doc_id, w, {pairs.format("w")} AS b FROM x),
v AS MATERIALIZED (SELECT doc_id, id, tb, unnest(list_transform(range(1, len(w)), lambda i: w[i : i + m - 1])) AS q FROM (SELECT doc_id, w, id, t.b AS tb, m FROM k, t WHERE len(k.b) > 0 AND 3 * len(list_intersect(k.b, t.b)) > 2 * len(t.b) - 3)),
u AS MATERIALIZED (SELECT doc_id, id, 2000000 * c // n AS d FROM (SELECT doc_id, id, len(list_intersect(b, tb)) AS c, len(b) + len(tb) AS n FROM (SELECT doc_id, id, tb, {pairs.format("q")} AS b FROM v) WHERE len(b) > 0) WHERE 200 * c >= {THRESHOLD} * n),
h AS MATERIALIZED (SELECT doc_id, s, id, 2000000 * c // n AS d FROM (SELECT doc_id, s, id, len(list_intersect(g.b, t.b)) AS c, len(g.b) + len(t.b) AS n FROM g, t WHERE len(g.b) > 0) WHERE 200 * c >= {THRESHOLD} * n),
e AS MATERIALIZED (SELECT doc_id, id, d FROM h UNION ALL SELECT doc_id, id, d FROM u),
a AS (SELECT doc_id, max(d) AS d, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM e GROUP BY 1),
y AS (SELECT e.doc_id, min(id) AS id FROM e JOIN a ON a.doc_id = e.doc_id AND a.d = e.d GROUP BY 1)
SELECT z.doc_id, z.n AS n_segments, coalesce(p.n, 0) AS n_matched, coalesce(r.n, 0) AS n_windows, coalesce(ids, '') AS licences, y.id AS best, CAST(a.d AS BIGINT) AS best_dice
FROM (SELECT doc_id, count(*) FILTER (s <> '') AS n FROM s GROUP BY 1) z LEFT JOIN a ON a.doc_id = z.doc_id LEFT JOIN y ON y.doc_id = z.doc_id
LEFT JOIN (SELECT doc_id, count(DISTINCT s) AS n FROM h GROUP BY 1) p ON p.doc_id = z.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM u GROUP BY 1) r ON r.doc_id = z.doc_id"""


LICENCES = _licences()

AUDIT = """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY 1),
f AS MATERIALIZED (SELECT part, coalesce(q, 0) AS q, coalesce(t, 0) AS t, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * len(regexp_replace(x, '[^A-Z]+', '', 'g')) > 10 * len(x) AS c, regexp_matches(x, '[#$%&*|]') AS d, coalesce(min(w.doc_id) OVER (PARTITION BY x) < w.doc_id, false) AS e FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS MATERIALIZED (SELECT part, a, b, c, d, e, count(*) AS n, sum(q) AS q, sum(t) AS t FROM f GROUP BY ALL),
i AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS i),
o AS (SELECT v.i || w.i || x.i || y.i || z.i AS o FROM i v, i w, i x, i y, i z WHERE len(list_distinct([v.i, w.i, x.i, y.i, z.i])) = 5),
s AS (SELECT o, k AS step, o[k] AS filter, o[1 : k - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
h AS (SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda i: CASE i WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM g),
r AS MATERIALIZED (SELECT part, o AS filter_order, step, filter, CAST(coalesce(sum(n) FILTER (NOT early AND NOT now), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT early AND now), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (early AND now), 0) AS BIGINT) AS redundant,
CAST(coalesce(sum(n) FILTER (fails = [filter]), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(q) FILTER (NOT early AND now), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(t) FILTER (NOT early AND now), 0) AS BIGINT) AS toxic_lost
FROM (SELECT h.*, s.*, list_contains(fails, filter) AS now, len(list_filter(fails, lambda i: contains(before, i))) > 0 AS early FROM h, s) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""

IMPORTANCE = f"""
WITH c AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b)) AS c),
d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents), i AS MATERIALIZED (SELECT {WORDS} AS w FROM benchmark),
v AS MATERIALIZED (SELECT w, hex(encode(w)) AS h FROM (SELECT unnest(w) AS w FROM d UNION SELECT unnest(w) FROM i)),
b AS MATERIALIZED (SELECT w, xor(4294967295, list_reduce(list_transform(range(1, len(h), 2), lambda k: CAST('0x' || substr(h, k, 2) AS BIGINT)), lambda r, x: xor(r >> 8, c[(xor(r, x) & 255) + 1]), 4294967295)) % 10000 AS b FROM v, c),
f AS MATERIALIZED (SELECT doc_id, row, b FROM (SELECT doc_id, row, unnest(w) AS w FROM (SELECT *, row_number() OVER () AS row FROM d)) JOIN b USING (w)),
s AS (SELECT b, count(*) AS s FROM f GROUP BY 1), t AS (SELECT b, count(*) AS t FROM (SELECT unnest(w) AS w FROM i) JOIN b USING (w) GROUP BY 1),
g AS MATERIALIZED (SELECT s.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000.0::DOUBLE) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t ON s.b = t.b),
m AS (SELECT row, CAST(floor(sum(g) / count(*)) AS BIGINT) AS m FROM f JOIN g USING (b) GROUP BY 1),
e AS MATERIALIZED (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(m, 0) AS weight, coalesce(m, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM (SELECT *, row_number() OVER () AS row FROM d) d LEFT JOIN m ON m.row = d.row),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM e WHERE n_features >= 20) THEN r END AS rank FROM o"""
