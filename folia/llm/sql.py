"""DuckDB SQL of those training-data queries that SQL can state."""

P1_FOUND = r"""
WITH types AS (SELECT lower(trim(alias)) AS a, min(document_type) AS t FROM doc_types GROUP BY 1),
members AS (SELECT DISTINCT group_id, pub_id FROM article_groups),
r AS (
  SELECT m.group_id, coalesce(s.trust_rank, 2147483647) AS k1, -coalesce(epoch_us(a.indexed_at), -4611686018427387904) AS k2, a.pub_id AS k3,
    regexp_replace(regexp_replace(regexp_replace(lower(a.doi), '\s+', '', 'g'), '^(https?://)?([a-z0-9-]+\.)*doi\.[a-z]+/|^doi[:.]?', ''), '[.,;:)\]}>''"]+$', '') AS d,
    t.t AS document_type,
    regexp_replace(regexp_replace(upper(a.issn), '^\s*((E-?|P-?)?ISSN)[\s:]*', ''), '[\s\-]+', '', 'g') AS i
  FROM members m JOIN articles a USING (pub_id) LEFT JOIN source_trust s USING (db) LEFT JOIN types t ON t.a = lower(trim(a.document_type))
),
v AS (
  SELECT *, CASE WHEN regexp_matches(d, '^10\.[0-9]{4,5}/.+$') AND NOT starts_with(d, '10.0000/') THEN d END AS doi,
    CASE WHEN regexp_matches(i, '^[0-9]{7}[0-9X]$') AND length(replace(i, left(i, 1), '')) > 0
      AND (list_sum(list_transform(range(1, 8), lambda n: (9 - n) * CAST(substr(i, CAST(n AS BIGINT), 1) AS INT))) + CASE WHEN right(i, 1) = 'X' THEN 10 ELSE CAST(right(i, 1) AS INT) END) % 11 = 0
      THEN left(i, 4) || '-' || right(i, 4) END AS issn FROM r
),
whole AS (
  SELECT group_id, doi, k1, k2, k3 FROM v x WHERE doi IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM v y WHERE y.group_id = x.group_id AND y.doi <> x.doi AND starts_with(y.doi, x.doi))
),
bd AS (SELECT group_id, first(doi ORDER BY k1, k2, k3) AS doi FROM whole GROUP BY 1),
bt AS (SELECT group_id, first(document_type ORDER BY k1, k2, k3) AS document_type FROM v WHERE document_type IS NOT NULL GROUP BY 1),
bi AS (SELECT group_id, first(issn ORDER BY k1, k2, k3) AS issn FROM v WHERE issn IS NOT NULL GROUP BY 1)
SELECT g.group_id, coalesce(bd.doi, 'unknown') AS doi, coalesce(bt.document_type, 'unknown') AS document_type, coalesce(bi.issn, 'unknown') AS issn
FROM (SELECT DISTINCT group_id FROM article_groups WHERE group_id IS NOT NULL) g LEFT JOIN bd USING (group_id) LEFT JOIN bt USING (group_id) LEFT JOIN bi USING (group_id)
"""
