"""DuckDB SQL for the training-data operators that SQL can express."""

SQL = {
    "op8_warc": """
WITH heads AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (SELECT hex, min(page_id) AS original FROM heads GROUP BY hex)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((('0x' || substr(heads.hex, 1 + 5 * CAST(i // 4 AS INT), 5))::BIGINT >> (5 * (3 - CAST(i % 4 AS INT)))) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM heads JOIN firsts USING (hex)
""",
    "op6_winnowing": """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (SELECT item_id, w, least(10, len(w)) AS k FROM iw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM items)),
lens AS (SELECT DISTINCT k FROM items),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM dw, lens WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, k, i FROM grams JOIN windows USING (k, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
""",
}
