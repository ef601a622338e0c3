"""DuckDB SQL that gives the rows of queries of this subpackage, over `documents` and `benchmark`."""

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOW.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = rf"regexp_extract_all({_LOW.format('text')}, '[^\x20\x09-\x0D]+')"

#: Windows of every width that items have, joined by their words.
DECONTAMINATE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, least(len(w), 8) AS k, unnest(list_transform(range(1, greatest(2, len(w) - 6)), lambda p: array_to_string(w[p : p + 7], ' '))) AS g FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
o AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM g)),
h AS (SELECT doc_id, p, g.k, item FROM (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM o) a JOIN g ON a.g = g.g AND a.k = g.k),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: All pairs with a common shingle, and what each document reaches.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(w) - 2)), lambda p: array_to_string(w[p : p + 3], ' '))) AS s FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT doc_id, coalesce(max(len(s)), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN s USING (doc_id) GROUP BY doc_id"""
