"""The derived catalog in DuckDB's SQL: common table expressions that the queries' SQL builds on."""

from __future__ import annotations

from ..functions.formats import EXTENSIONS
from ..sources.catalog import NOW_MS

TWO_WORDS = r"'^[^\p{L}\p{N}]*([\p{L}\p{N}]+)(?:[^\p{L}\p{N}]+([\p{L}\p{N}]+))?'"
EXTS = ", ".join(f"'{e}'" for e in EXTENSIONS)
KINDS = ", ".join(f"('{e}', '{k}')" for e, k in EXTENSIONS.items())

CATALOG = rf"""
kinds(ext, kind) AS (VALUES {KINDS}),
base AS (
  SELECT doc_id AS id, lang, source, text, lower(text) AS lt, list_extract([{EXTS}], CAST(doc_id % {len(EXTENSIONS)} AS INT) + 1) AS ext, strlen(text) AS size,
    {NOW_MS} - ((doc_id * 7919) % 800) * 86400000 AS modified_at, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 2 WHEN doc_id % 11 = 0 THEN 3 ELSE 1 END AS content_status FROM documents),
plain AS (
  SELECT id, coalesce(regexp_extract(lt, {TWO_WORDS}, 1), '') || ' ' || coalesce(regexp_extract(lt, {TWO_WORDS}, 2), '') || ' ' || id || '.' || ext AS name,
    ext, kind, '/data/' || lang AS root, '/data/' || lang || '/' || source AS dir, size, modified_at, content_status, lang, source, text FROM base JOIN kinds USING (ext)),
opens AS (SELECT user_id AS file_id, epoch_us(ts) // 1000 AS at_ms, event_id AS seq FROM events WHERE event_type = 'view'),
fav AS (SELECT doc_id AS id, max(quality) = 1 AS is_favourite FROM labels GROUP BY 1),
op AS (SELECT file_id AS id, count(*) AS open_count, max(at_ms) AS last_opened_at FROM opens GROUP BY 1),
cat AS (SELECT p.*, dir || '/' || name AS path, coalesce(is_favourite, false) AS is_favourite, coalesce(open_count, 0) AS open_count, last_opened_at FROM plain p LEFT JOIN fav USING (id) LEFT JOIN op USING (id)),
roots AS (SELECT row_number() OVER (ORDER BY lang) AS id, '/data/' || lang AS path, lang <> 'fr' AS enabled FROM (SELECT DISTINCT lang FROM documents)),
rooted AS (SELECT cat.*, roots.id AS root_id FROM cat JOIN roots ON cat.root = roots.path),
patterns AS (SELECT CASE WHEN n % 7 = 0 THEN upper(source) WHEN n % 7 = 1 THEN ' /data/EN/' || source || '/ ' WHEN n % 7 = 2 THEN '/' END AS pattern FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents) WHERE n % 7 < 3),
rules AS (SELECT DISTINCT lower(regexp_replace(trim(pattern), '/+$', '')) AS rule, contains(regexp_replace(trim(pattern), '/+$', ''), '/') AS is_path FROM patterns WHERE regexp_replace(trim(pattern), '/+$', '') <> ''),
hidden AS (SELECT DISTINCT path FROM cat JOIN rules ON CASE WHEN is_path THEN lower(dir) = rule ELSE lower(regexp_extract(dir, '([^/]*)$', 1)) = rule END),
tags AS (SELECT 1 AS id, 'Toxic' AS name, 'brick' AS color UNION ALL SELECT 2, 'Quality', 'slate' UNION ALL SELECT row_number() OVER (ORDER BY lang) + 2, 'Lang ' || lang, 'moss' FROM (SELECT DISTINCT lang FROM documents)),
file_tags AS (SELECT doc_id AS file_id, 1 AS tag_id FROM labels WHERE toxic = 1 UNION SELECT doc_id, 2 FROM labels WHERE quality = 1 UNION SELECT doc_id, t.id FROM documents JOIN tags t ON t.name = 'Lang ' || lang),
seen0 AS (SELECT id, CASE WHEN id % 11 = 2 THEN upper(name) ELSE name END AS name, ext, kind, dir, root, CASE WHEN id % 7 = 1 THEN size + 1 ELSE size END AS size, modified_at FROM cat WHERE id % 10 <> 3
  UNION ALL SELECT id, 'new ' || name, ext, kind, dir, root, size, modified_at FROM cat WHERE id % 10 <> 3 AND id % 13 = 5),
seen AS (SELECT * EXCLUDE (id), dir || '/' || name AS path FROM seen0)
"""


def sql(body: str) -> str:
    """body may use the tables above; it begins with SELECT, or with further common table expressions after a comma."""
    return f"WITH RECURSIVE {CATALOG.strip()}\n{body.strip()}"
