"""DuckDB SQL with the results of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op6_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id)
"""

ORACLES["op8_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
occ AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.words = win.words),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_X = "[CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding]"


def _round(before: str, after: str) -> str:
    """Assignment of every part to the entries of ``before`` and the codebooks ``after`` it."""
    return f"""
{after}_near AS (
  SELECT row, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
  FROM (SELECT p.row, p.part, b.entry,
               CAST(list_sum([(p.c[i] - b.c[i]) * (p.c[i] - b.c[i]) for i in range(1, len(p.c) + 1)]) AS BIGINT) AS d
        FROM parts p JOIN {before} b USING (part))
  GROUP BY row, part),
{after}_mean AS (
  SELECT part, entry, list(m ORDER BY i) AS c
  FROM (SELECT part, entry, i, CAST(floor(sum(c[i]) / count(*)) AS BIGINT) AS m
        FROM {after}_near JOIN parts USING (row, part), (SELECT unnest(range(1, max(len(c)) + 1)) AS i FROM parts)
        GROUP BY part, entry, i)
  GROUP BY part, entry),
{after} AS (SELECT part, entry, coalesce(n.c, b.c) AS c FROM {before} b LEFT JOIN {after}_mean n USING (part, entry))"""


ORACLES["op12_vector_codes"] = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, {_X} AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
parts AS (
  SELECT row, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS c
  FROM kept, (SELECT unnest(range(16)) AS part)),
book0 AS (SELECT part, row - 1 AS entry, c FROM parts WHERE row <= 64),
{_round("book0", "book1")},
{_round("book1", "book2")},
{_round("book2", "book3")},
digest AS (
  SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2),
coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM book3_near GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), digest
"""
