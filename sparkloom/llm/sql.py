"""SQL (DuckDB) for those queries of this subpackage that it can express, written independently of the operators."""

from __future__ import annotations

from .common import LOWER, UPPER
from .license_texts import BASE, NOTICES

_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Exact similarities of all pairs that share a shingle, then classes as the closure of the links.
NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END AS s FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, s, 1 + ln(count(*)) AS weight FROM (SELECT doc_id, unnest(s) AS s FROM g) GROUP BY doc_id, s),
total AS (SELECT doc_id, count(*) AS n, sum(weight) AS weight FROM e GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n, sum(least(a.weight, b.weight)) AS weight FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b WHERE 5 * p.n >= 4 * (x.n + y.n - p.n) OR p.weight >= 0.8 * (x.weight + y.weight - p.weight) - 1e-9),
near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
root AS (SELECT d.doc_id, coalesce(least(d.doc_id, min(r.b)), d.doc_id) AS class_id FROM d LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM root"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT doc_id, i, l[i] AS line, len(l) AS n, strlen(l[i]) AS bytes,
         substr(md5(concat(md5(l[i - 1]), md5(l[i]))), 32) IN ('0', '4', '8', 'c') AND i > 1 AS mark FROM d, LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)),
cut AS (SELECT *, i = n OR (mark AND NOT coalesce(lag(mark) OVER (PARTITION BY doc_id ORDER BY i), false)) AS ends FROM line),
numbered AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM cut),
chunk AS (SELECT doc_id, min(i) AS first, max(i) AS last, sum(bytes) AS bytes, string_agg(line, chr(10) ORDER BY i) AS text FROM numbered GROUP BY doc_id, c HAVING count(*) > 2
          UNION ALL
          SELECT a.doc_id, a.i, b.i, a.bytes + b.bytes, concat(a.line, chr(10), b.line) FROM line a JOIN line b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
seen AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, first) > 1 AS again FROM chunk WHERE bytes >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS i FROM seen WHERE again),
told AS (SELECT numbered.*, gone.i IS NOT NULL AS gone FROM numbered LEFT JOIN gone USING (doc_id, i))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS removed_lines,
       cast(strlen(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS bigint) AS kept_bytes, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
item AS (SELECT cast(item_id AS varchar) AS item, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS win FROM item, LATERAL (SELECT unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS k) WHERE len(w) > 0),
places_ AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win FROM d, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS p)),
hit AS (SELECT DISTINCT doc_id, p, n, item FROM places_ JOIN win USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _template_rows() -> str:
    rows = [(p, x, "true") for p, x in BASE.items()] + [(p, x, "false") for p, x in NOTICES.items()]
    return ", ".join(f"({i}, '{p}', '{x}', {exact})" for i, (p, x, exact) in enumerate(rows))


LICENSE_SCAN = f"""
WITH t AS (SELECT * FROM (VALUES {_template_rows()}) AS t(tid, phrase, label, exact)),
tg AS (SELECT tid, label, exact, len(string_split(phrase, ' ')) - 1 AS grams, k AS tpos, array_to_string(list_slice(string_split(phrase, ' '), k, k + 1), ' ') AS gram
       FROM t, LATERAL (SELECT unnest(generate_series(1, len(string_split(phrase, ' ')) - 1)) AS k)),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
dg AS (SELECT doc_id, k AS pos, array_to_string(list_slice(w, k, k + 1), ' ') AS gram FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 1)) AS k)),
votes AS (SELECT DISTINCT doc_id, tid, label, exact, grams, pos - tpos AS diagonal, tpos FROM dg JOIN tg USING (gram)),
diagonals AS (SELECT DISTINCT doc_id, tid, exact, diagonal FROM votes),
marked AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) > 3 THEN 1 ELSE 0 END AS fresh FROM diagonals),
spans AS (SELECT doc_id, tid, diagonal, sum(fresh) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM marked),
held AS (SELECT v.doc_id, v.tid, v.label, v.exact, s.span, min(v.diagonal) AS start, count(DISTINCT tpos) / any_value(v.grams) AS share
         FROM votes v JOIN spans s ON s.doc_id = v.doc_id AND s.tid = v.tid AND s.diagonal = v.diagonal GROUP BY ALL),
good AS (SELECT *, CASE WHEN exact THEN share = 1 ELSE share >= 0.85 END AS good FROM held)
SELECT d.doc_id, cast(len(any_value(d.w)) AS bigint) AS n_words, count(*) FILTER (exact AND good) AS n_base, cast(min(start) FILTER (exact AND good) AS bigint) AS first_word, cast(max(start) FILTER (exact AND good) AS bigint) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND good), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good), '') AS labels,
       cast(coalesce(max(CASE WHEN NOT exact THEN share WHEN good THEN 1.0 END), 0) AS double) AS score
FROM d LEFT JOIN good g ON g.doc_id = d.doc_id GROUP BY d.doc_id"""

ORACLES = {"op3_near_dedup": NEAR_DEDUP, "op5_line_dedup": LINE_DEDUP, "op6_decontamination": DECONTAMINATION, "op9_license_scan": LICENSE_SCAN}
