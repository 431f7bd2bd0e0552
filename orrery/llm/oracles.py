"""SQL that some numbered queries must agree with."""

import string

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

SUBSTRING = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM d, unnest(range(1, len(w) - 48)) AS r(i)
), first_seen AS (
  SELECT g, min(doc_id) AS least FROM win GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first_seen USING (g) WHERE least < doc_id
), gone_of AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n_removed FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n_removed IS NULL THEN w
    ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone_of USING (doc_id)
"""


def bench_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, {bench_words('text')} AS w FROM documents
), b AS (
  SELECT item_id, least(13, len(w)) AS n, w FROM (SELECT item_id, {bench_words('text')} AS w FROM benchmark) WHERE len(w) > 0
), pattern AS (
  SELECT DISTINCT n, item_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM b, unnest(range(1, len(w) - n + 2)) AS r(i)
), win AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM pattern), unnest(range(1, len(w) - n + 2)) AS r(i)
), hit AS (
  SELECT doc_id, i, n, item_id FROM win JOIN pattern USING (n, g)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def lloyd(rounds: int) -> str:
    """Codebooks by rounds of plain distances between all parts and entries."""
    steps = "".join(f"""
, near{k} AS MATERIALIZED (
  SELECT r, p, min(d * 256 + e) AS m FROM (
    SELECT r, p, e, sum((val.v - book{k}.v) * (val.v - book{k}.v))::BIGINT AS d FROM val JOIN book{k} USING (p, i) GROUP BY r, p, e
  ) GROUP BY r, p
), book{k + 1} AS MATERIALIZED (
  SELECT p, e, i, coalesce(mean.v, book{k}.v) AS v FROM book{k} LEFT JOIN (
    SELECT p, (m % 256)::BIGINT AS e, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM val JOIN near{k} USING (r, p) GROUP BY ALL
  ) mean USING (p, e, i)
)""" for k in range(rounds + 1))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), num AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, vec_id, label, x, len(x) // 4 AS w FROM kept
), val AS MATERIALIZED (
  SELECT r, (q - 1) // w AS p, (q - 1) % w AS i, x[q] AS v FROM num, unnest(range(1, len(x) + 1)) AS t(q)
), book0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, i, v FROM val WHERE r <= 256
){steps}, digest AS (
  SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{rounds}
), coded AS (
  SELECT r, string_agg(format('{{:02x}}', (m % 256)::BIGINT), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM num JOIN coded USING (r), digest
"""
