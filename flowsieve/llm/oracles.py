"""DuckDB SQL of the first ten operators' queries, where SQL can state the whole result."""

#: Windows of 50 bytes as hexadecimal text; removed windows joined to islands; what lies between is kept.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(generate_series(0, CAST(length(h) // 2 - 50 AS BIGINT))) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE w.doc_id > f.first),
m AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM m),
o AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, g, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM o),
e AS (SELECT d.doc_id, length(h) // 2 AS n, count(a) AS spans, coalesce(sum(b - a), 0) AS gone,
             coalesce(string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a), '')
               || substr(any_value(h), CAST(2 * coalesce(max(b), 0) + 1 AS BIGINT)) AS kept
      FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, h)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
       sha256(unhex(kept)) AS kept_sha256 FROM e
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Every window of the items looked up among the documents' word sequences of its length.
DECONTAMINATE = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
      FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT p.doc_id, p.i, p.k, win.item FROM p JOIN win ON win.k = p.k AND win.g = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hw.n > 0 AND 20 * hw.n >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
