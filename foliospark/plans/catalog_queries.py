"""Queries over sources, scope, sync, browsing, aggregates, duplicates and annotations, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, paths, text
from ..operators import aggregates, annotations, browse, duplicates, scope, sync, versions
from ..sources import catalog as c
from ..sources.work import shared_dir, stored
from .sql import sql

Q: dict = {}
SQL: dict[str, str] = {}
NOW = c.NOW_MS


def query(name: str, body: str | None = None, raw: bool = False):
    def add(f):
        Q[name] = f
        if body is not None:
            SQL[name] = body if raw else sql(body)
        return f

    return add


def raw_listing(s: SparkSession, d: str) -> DataFrame:
    """Files as a walk would see them: documents, lock files, other types."""
    r = c.derived(s, d, annotated=False)
    name = F.when(F.col("id") % 17 == 0, F.concat(F.lit("~$"), "name")).when(F.col("id") % 19 == 0, F.concat("name", F.lit(".exe"))).when(F.col("id") % 23 == 0, F.upper("name")).when(F.col("id") % 29 == 0, F.lit("v1.2.3456")).otherwise(F.col("name"))
    return r.select(F.concat("dir", F.lit("/"), name).alias("path"), "size", "modified_at")


RAW = "raw AS (SELECT id, CASE WHEN id % 17 = 0 THEN '~$' || name WHEN id % 19 = 0 THEN name || '.exe' WHEN id % 23 = 0 THEN upper(name) WHEN id % 29 = 0 THEN 'v1.2.3456' ELSE name END AS name, dir, size, modified_at FROM cat), flagged AS (SELECT raw.*, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM raw)"


def rooted(s: SparkSession, d: str) -> DataFrame:
    """The derived catalog with the root_id of each document's location, paused or not."""
    return scope.owning_root(c.derived(s, d).drop("root"), c.roots(s, d).withColumn("enabled", F.lit(True)))


def contents(s: SparkSession, d: str) -> DataFrame:
    return c.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))


# --- sources and scope


@query("src1_listing")
def _(s, d):
    return c.list_files(s, d).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "size")


@query("src2_records", f", {RAW} SELECT dir || '/' || name AS path, name, f.ext, kind, dir, size, modified_at FROM flagged f JOIN kinds USING (ext) WHERE ext NOT IN ('txt', 'md') AND NOT starts_with(name, '~$')")
def _(s, d):
    return c.to_records(raw_listing(s, d)).select("path", "name", "ext", "kind", "dir", "size", "modified_at")


@query("src3_src4_src5_src6_file_flags", f", {RAW} SELECT dir || '/' || name AS path, f.ext, kind, kind IS NOT NULL AND f.ext NOT IN ('pdf', 'md') AS enabled, starts_with(name, '~$') OR starts_with(name, '.~lock') OR starts_with(name, '~WRL') AS is_lock, regexp_matches(name, '^.+\\.[0-9A-Za-z]{{1,5}}$') AND regexp_matches(name, '\\.[0-9]*[A-Za-z][0-9A-Za-z]*$') AND kind IS NULL AS is_other FROM flagged f LEFT JOIN kinds USING (ext)")
def _(s, d):
    name = F.regexp_extract("path", "([^/]*)$", 1)
    ext = formats.extension(name)
    return raw_listing(s, d).select("path", ext.alias("ext"), formats.kind_of(ext).alias("kind"), formats.is_enabled(ext, ("pdf", "nonsense"), ("txt",)).alias("enabled"), formats.is_lock_file(name).alias("is_lock"), formats.is_other_file(name).alias("is_other"))


@query("src7_exclusion_rules", "SELECT rule, is_path FROM rules")
def _(s, d):
    return scope.compile_exclusions(c.exclusions(s, d))


@query("src8_src9_excluded_paths", "SELECT path FROM hidden")
def _(s, d):
    return scope.excluded(c.derived(s, d, annotated=False), scope.compile_exclusions(c.exclusions(s, d)))


@query("src10_path_containment", "SELECT id, lower(dir) = '/data/en' OR starts_with(lower(dir), '/data/en/') AS in_english, starts_with(lower(dir), '/data/de/src1/') OR lower(dir) = '/data/de/src1' AS in_one FROM cat")
def _(s, d):
    r = c.derived(s, d, annotated=False)
    return r.select("id", paths.is_within(F.col("dir"), F.lit("/DATA/en/")).alias("in_english"), paths.is_within(F.col("dir"), F.lit("/data/de/src1")).alias("in_one"))


@query("src11_normalized_roots", "SELECT pattern, CASE WHEN regexp_replace(trim(pattern), '/+$', '') = '' AND starts_with(trim(pattern), '/') THEN '/' ELSE regexp_replace(trim(pattern), '/+$', '') END AS root FROM patterns")
def _(s, d):
    return c.exclusions(s, d).select("pattern", paths.normalize_root(F.col("pattern")).alias("root"))


@query("src12_owning_root", "SELECT cat.id, r.id AS root_id FROM cat LEFT JOIN (SELECT * FROM roots WHERE enabled) r ON cat.root = r.path")
def _(s, d):
    return scope.owning_root(c.derived(s, d, annotated=False).drop("root"), c.roots(s, d)).select("id", "root_id")


@query("src13_in_scope", "SELECT cat.id, r.id AS root_id FROM cat JOIN roots r ON cat.root = r.path AND r.enabled WHERE cat.path NOT IN (SELECT path FROM hidden)")
def _(s, d):
    rows = c.derived(s, d, annotated=False).drop("root")
    return scope.in_scope(rows, c.roots(s, d), scope.compile_exclusions(c.exclusions(s, d))).select("id", "root_id")


@query(
    "src14_admit_roots",
    """, fresh AS (SELECT DISTINCT '/data/' || lang || '/' || source AS path FROM documents WHERE lang = 'en' UNION SELECT '/other' UNION SELECT '/old'), old AS (SELECT * FROM roots WHERE path <> '/data/fr' UNION ALL SELECT 99, '/old/inner', true),
judged AS (SELECT fresh.path, CASE WHEN old.path IS NULL THEN 'added' ELSE 'covered' END AS outcome, old.path AS by FROM fresh LEFT JOIN old ON fresh.path = old.path OR starts_with(fresh.path, old.path || '/'))
SELECT * FROM judged UNION ALL SELECT '/old/inner', 'replaced', '/old'""",
)
def _(s, d):
    folders = c.derived(s, d, annotated=False).filter("root = '/data/en'").select(F.concat(F.lit(" "), "dir", F.lit("/")).alias("path")).distinct()
    more = s.createDataFrame([("/other/",), ("/old",)], "path string")
    old = c.roots(s, d).filter("path <> '/data/fr'").unionByName(s.createDataFrame([(99, "/old/inner", True)], "id long, path string, enabled boolean"))
    return scope.admit_roots(old, folders.unionByName(more))


@query("src15_remove_and_pause_root", "SELECT id, root_id, enabled FROM (SELECT id, root_id FROM rooted WHERE root_id <> 1) JOIN (SELECT id AS root_id, enabled AND id <> 2 AS enabled FROM roots) USING (root_id)")
def _(s, d):
    rows, left = scope.without_root(rooted(s, d), c.roots(s, d), 1)
    return rows.select("id", "root_id").join(scope.set_enabled(left, 2, False).select(F.col("id").alias("root_id"), "enabled"), "root_id")


@query("src16_excludable_folders", "SELECT id, 0 AS depth, dir AS folder FROM cat")
def _(s, d):
    return scope.excludable(c.derived(s, d, annotated=False), c.roots(s, d))


@query("snk1_versioned_catalog", "SELECT id, path, size FROM cat WHERE id % 2 = 0")
def _(s, d):

    rows, path = c.derived(s, d).select("id", "path", "size"), f"{shared_dir(s)}/catalog-{uuid.uuid4().hex}"
    versions.commit(rows, path, 1)
    versions.commit(rows.filter("id % 2 = 0"), path, 2)
    versions.commit(rows.filter("id % 3 = 0"), path, 2)  # a retry of batch 2 changes nothing
    return versions.current(s, path)


# --- sync


@query("syn1_snapshot", "SELECT lower(path) AS path_key, id, name, size, modified_at FROM rooted WHERE root_id = 1")
def _(s, d):
    return sync.snapshot(rooted(s, d), 1)


DIFF = """both_sides AS (SELECT coalesce(k.path_key, lower(s.path)) AS path_key, k.id, CASE WHEN k.id IS NULL THEN 'added' WHEN s.path IS NULL THEN 'gone' WHEN k.size IS NOT DISTINCT FROM s.size AND k.modified_at IS NOT DISTINCT FROM s.modified_at AND k.name IS NOT DISTINCT FROM s.name THEN 'unchanged' ELSE 'updated' END AS change
FROM (SELECT lower(path) AS path_key, * FROM cat) k FULL OUTER JOIN seen s ON k.path_key = lower(s.path))"""


@query("syn2_diff", f", {DIFF} SELECT * FROM both_sides")
def _(s, d):
    return sync.diff(sync.snapshot(c.derived(s, d, annotated=False)), c.observed(s, d))


@query("syn7_summary", f", {DIFF} SELECT count(*) FILTER (change <> 'gone') AS found, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'gone') AS removed FROM both_sides")
def _(s, d):
    return sync.summary(sync.diff(sync.snapshot(c.derived(s, d, annotated=False)), c.observed(s, d)))


def _stored_catalog(s, d):
    return rooted(s, d).withColumn("hash", F.concat(F.lit("h"), F.col("id")))


def _seen_rooted(s, d):
    return scope.owning_root(c.observed(s, d).drop("root"), c.roots(s, d).withColumn("enabled", F.lit(True)))


@query(
    "syn3_upsert_on_path",
    f""" SELECT o.id, o.path, o.name, o.ext, o.kind, o.dir, r.id AS root_id, n.size, n.modified_at, CASE WHEN o.size = n.size AND o.modified_at = n.modified_at THEN o.content_status ELSE 0 END AS content_status, CASE WHEN o.size = n.size AND o.modified_at = n.modified_at THEN 'h' || o.id END AS hash, {NOW} AS last_seen_at, 'updated' AS outcome
FROM rooted o JOIN seen n ON lower(o.path) = lower(n.path) JOIN roots r ON n.root = r.path
UNION ALL SELECT NULL, n.path, n.name, n.ext, n.kind, n.dir, r.id, n.size, n.modified_at, 0, NULL, {NOW}, 'added' FROM seen n JOIN roots r ON n.root = r.path WHERE lower(n.path) NOT IN (SELECT lower(path) FROM cat)""",
)
def _(s, d):
    return sync.upsert_on_path(_stored_catalog(s, d), _seen_rooted(s, d), NOW)


@query(
    "syn4_update_by_id",
    "SELECT o.id, n.path, n.name, o.size + (CASE WHEN o.id % 7 = 1 THEN 1 ELSE 0 END) AS size, CASE WHEN o.id % 7 = 1 THEN 0 ELSE o.content_status END AS content_status, CASE WHEN o.id % 7 <> 1 THEN 'h' || o.id END AS hash, o.is_favourite, o.open_count FROM rooted o JOIN seen n ON lower(o.path) = lower(n.path)",
)
def _(s, d):
    cat = _stored_catalog(s, d)
    rows = c.observed(s, d).withColumn("key", F.lower("path")).join(cat.select("id", F.lower("path").alias("key")), "key").drop("key")
    return sync.update_by_id(cat, rows).select("id", "path", "name", "size", "content_status", "hash", "is_favourite", "open_count")


@query("syn5_syn6_gone_and_orphans", "SELECT id FROM rooted WHERE root_id IN (SELECT id FROM roots WHERE enabled) AND lower(path) NOT IN (SELECT lower(path) FROM seen) UNION ALL SELECT -1 - id FROM rooted WHERE id % 9 <> 0")
def _(s, d):
    cat = rooted(s, d)
    done = c.roots(s, d).filter("enabled").select(F.col("id").alias("root_id"))
    orphaned = cat.withColumn("root_id", F.when(F.col("id") % 9 != 0, F.col("root_id")))
    return sync.gone(cat, c.observed(s, d), done).unionByName(sync.without_orphans(orphaned).select((-1 - F.col("id")).alias("id")))


@query("syn8_purge", "SELECT id FROM cat WHERE ext IN ('txt', 'md', 'pdf') UNION SELECT id FROM cat WHERE path IN (SELECT path FROM hidden)")
def _(s, d):
    return scope.no_longer_covered(c.derived(s, d, annotated=False), c.roots(s, d), scope.compile_exclusions(c.exclusions(s, d)), ("pdf",))


@query("syn9_delete_cascade", "SELECT 'catalog' AS tbl, id, 0 AS tag_id FROM cat WHERE id % 3 <> 0 UNION ALL SELECT 'file_tags', file_id, tag_id FROM file_tags WHERE file_id % 3 <> 0")
def _(s, d):
    cat = c.derived(s, d)
    left = sync.delete_ids(cat.filter("id % 3 = 0").select("id"), {"catalog": (cat, "id"), "file_tags": (c.file_tags(s, d), "file_id")})
    return left["catalog"].select(F.lit("catalog").alias("tbl"), "id", F.lit(0).cast("long").alias("tag_id")).unionByName(left["file_tags"].select(F.lit("file_tags").alias("tbl"), F.col("file_id").alias("id"), "tag_id"))


# --- browsing

ROW = "id, path, kind, size, modified_at"


@query("lst1_view", f"SELECT {ROW} FROM cat WHERE kind = 'word' AND modified_at >= {NOW - 400 * 86400000} AND is_favourite AND id IN (SELECT file_id FROM file_tags WHERE tag_id = 3)")
def _(s, d):
    return browse.view(c.derived(s, d), "word", NOW - 400 * c.DAY_MS, favourites=True, tag_id=3, file_tags=c.file_tags(s, d)).select("id", "path", "kind", "size", "modified_at")


@query(
    "lst2_lst3_sorted_pages",
    """SELECT 'opened' AS by, id, total FROM (SELECT id, count(*) OVER () AS total, last_opened_at, name FROM cat) x ORDER BY last_opened_at DESC NULLS LAST, lower(name), id LIMIT 50 OFFSET 20""",
)
def _(s, d):
    return browse.page_with_total(c.derived(s, d), browse.sort_key("opened", True), 50, 20).select(F.lit("opened").alias("by"), "id", "total")


@query("lst2_by_name", "SELECT id, name FROM cat ORDER BY lower(name), id LIMIT 30")
def _(s, d):
    return browse.page(c.derived(s, d), browse.sort_key("name", False), 30, -5).select("id", "name")


@query("lst4_page_tags", "SELECT id, (SELECT array_to_string(list_sort(list(tag_id)), ',') FROM file_tags WHERE file_id = p.id) AS tags FROM (SELECT id FROM cat ORDER BY size DESC, lower(name), id LIMIT 200) p")
def _(s, d):
    rows = browse.page(c.derived(s, d), browse.sort_key("size", True))
    return browse.with_tags(rows, c.file_tags(s, d)).select("id", F.array_join(F.transform("tags", lambda t: t.cast("string")), ",").alias("tags"))


@query("lst5_lst6_lookup", "SELECT id, path FROM cat WHERE starts_with(lower(path), '/data/es/src1/') UNION ALL SELECT id, path FROM cat WHERE lower(path) = (SELECT lower(path) FROM cat WHERE id = 7)")
def _(s, d):
    cat = stored(browse.keyed(c.derived(s, d, annotated=False)), "keyed")
    path = cat.filter("id = 7").select("path").first()
    return browse.under(cat, "/data/ES/src1/").select("id", "path").unionByName(browse.by_path(cat, path["path"].upper()).select("id", "path"))


@query("lst7_txt9_details", "SELECT id, path, content_status, substr(text, 1, 1400) AS excerpt, (SELECT array_to_string(list_sort(list(tag_id)), ',') FROM file_tags WHERE file_id = cat.id) AS tags FROM cat")
def _(s, d):
    texts = c.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return browse.details(c.derived(s, d), texts, c.file_tags(s, d)).select("id", "path", "content_status", "excerpt", F.array_join(F.transform("tags", lambda t: t.cast("string")), ",").alias("tags"))


@query("lst8_presets", f"SELECT 'recent' AS view, id FROM cat WHERE modified_at >= ({NOW + 1234567} - 2592000000) // 3600000 * 3600000 UNION ALL SELECT 'opened', id FROM cat WHERE last_opened_at IS NOT NULL UNION ALL SELECT 'tag', file_id FROM file_tags WHERE tag_id = 1 UNION ALL SELECT 'favourites', id FROM cat WHERE is_favourite")
def _(s, d):
    cat, tagged = c.derived(s, d), c.file_tags(s, d)
    one = lambda name, **k: browse.preset(cat, name, NOW + 1_234_567, **k)[0].select(F.lit(name).alias("view"), "id")
    return one("recent").unionByName(one("opened")).unionByName(one("tag", tag_id=1, file_tags=tagged)).unionByName(one("favourites"))


@query("lst9_visible_kinds", "SELECT DISTINCT kind FROM kinds WHERE ext IN (SELECT ext FROM cat) AND kind <> 'slides'")
def _(s, d):
    found = aggregates.formats(c.derived(s, d), ("ppt", "pptx", "pptm", "pps", "ppsx", "odp"), ("txt", "md"))
    return browse.visible_kinds(found.filter("n > 0"))


# --- aggregates


@query("agg1_totals", "SELECT count(*) AS total, sum(size) AS bytes, count(*) FILTER (is_favourite) AS favourites, count(last_opened_at) AS opened, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM cat GROUP BY kind)) AS by_kind FROM cat")
def _(s, d):
    pairs = F.transform(F.map_entries("by_kind"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return aggregates.totals(c.derived(s, d)).withColumn("by_kind", F.array_join(F.array_sort(pairs), ","))


@query("agg2_agg7_usage_by_kind", "SELECT kind, n, bytes, bytes / sum(bytes) OVER () AS share FROM (SELECT kind, count(*) AS n, sum(size) AS bytes FROM cat GROUP BY kind)")
def _(s, d):
    return aggregates.by_kind(c.derived(s, d, annotated=False))


@query("agg3_agg4_counts", "SELECT 'ext' AS what, ext AS value, count(*) AS n FROM cat GROUP BY ext UNION ALL SELECT 'root', CAST(root_id AS VARCHAR), count(*) FROM rooted GROUP BY root_id")
def _(s, d):
    cat = rooted(s, d)
    one = lambda what, col: aggregates.count_by(cat, col).select(F.lit(what).alias("what"), F.col(col).cast("string").alias("value"), "n")
    return one("ext", "ext").unionByName(one("root", "root_id"))


@query("agg5_largest", "SELECT id, size FROM cat ORDER BY size DESC, id LIMIT 12")
def _(s, d):
    return aggregates.largest(c.derived(s, d, annotated=False)).select("id", "size")


@query("agg6_txt2_formats", "SELECT k.ext, k.kind, k.ext NOT IN ('rtf', 'txt', 'md') AS enabled, coalesce(n, 0) AS n, k.ext NOT IN ('doc', 'dot', 'ppt', 'pps') AS readable FROM kinds k LEFT JOIN (SELECT ext, count(*) AS n FROM cat WHERE id % 22 <> 5 GROUP BY ext) USING (ext)")
def _(s, d):
    return aggregates.formats(c.derived(s, d, annotated=False).filter("id % 22 <> 5"), ("rtf",))


@query("agg8_overview", "SELECT count(*) AS total, sum(size) AS bytes, count(*) FILTER (is_favourite) AS favourites, count(last_opened_at) AS opened, count(*) FILTER (content_status = 0 AND ext NOT IN ('doc', 'dot', 'ppt', 'pps')) AS pending, (SELECT count(*) FROM roots WHERE enabled) AS active_roots, 'md,rtf,txt' AS disabled_formats FROM cat")
def _(s, d):
    return aggregates.overview(c.derived(s, d), c.roots(s, d), ("rtf",))


@query("agg9_tag_usage", "SELECT id, name, color, (SELECT count(*) FROM file_tags WHERE tag_id = t.id AND tag_id <> 4) AS n FROM tags t")
def _(s, d):
    return aggregates.tag_usage(c.tags(s, d), c.file_tags(s, d).filter("tag_id <> 4"))


@query("agg10_root_inventory", "SELECT id, path, enabled, (SELECT count(*) FROM rooted WHERE root_id = r.id) AS n FROM roots r")
def _(s, d):
    return aggregates.root_inventory(c.roots(s, d), rooted(s, d))


@query("agg11_tiles", "SELECT kind, count(*) AS n, sum(size) AS bytes, string_agg(DISTINCT ext, ',' ORDER BY ext) AS exts FROM cat GROUP BY kind")
def _(s, d):
    return aggregates.tiles(c.derived(s, d, annotated=False))


# --- duplicates


@query("dup1_candidates", "SELECT id, size FROM cat WHERE size > 0 AND size IN (SELECT size FROM cat GROUP BY size HAVING count(*) > 1)")
def _(s, d):
    return duplicates.candidates(c.derived(s, d, annotated=False).select("id", "size"))


#: A parameter of the funnel: the derived documents are short.
HEAD = 1000
FUNNEL = f"""cand AS (SELECT id, size, text, CASE WHEN size > {HEAD} THEN sha256(encode(text)[1:{HEAD}]) ELSE '' END AS head FROM cat WHERE size > 0 AND size IN (SELECT size FROM cat GROUP BY size HAVING count(*) > 1)),
heads AS (SELECT * FROM cand WHERE head = '' OR (size, head) IN (SELECT (size, head) FROM cand GROUP BY size, head HAVING count(*) > 1)),
full_hash AS (SELECT id, size, sha256(text) AS hash FROM heads), sets AS (SELECT hash, size, count(*) AS n, row_number() OVER (ORDER BY size DESC, hash) AS group_id FROM full_hash GROUP BY hash, size HAVING count(*) > 1)"""


@query("dup2_head_filter", f", {FUNNEL} SELECT id, size FROM heads")
def _(s, d):
    rows = stored(duplicates.candidates(c.derived(s, d, annotated=False).select("id", "size")), "candidates")
    return duplicates.head_survivors(rows, contents(s, d), HEAD).select("id", "size")


@query("dup3_dup4_hashes", f", {FUNNEL} SELECT id, size, CASE WHEN id % 4 = 0 THEN 'cached' || id ELSE hash END AS hash FROM full_hash")
def _(s, d):
    rows = c.derived(s, d, annotated=False)
    cache = rows.filter("id % 4 < 2").select("id", (F.col("size") + F.col("id") % 4).alias("size"), "modified_at", F.concat(F.lit("cached"), F.col("id")).alias("hash"))
    return duplicates.with_hashes(rows, contents(s, d), cache, HEAD).select("id", "size", "hash")


@query("dup5_groups", f", {FUNNEL} SELECT id, size, hash, n, group_id FROM full_hash JOIN sets USING (hash, size)")
def _(s, d):
    return duplicates.groups(duplicates.with_hashes(c.derived(s, d, annotated=False), contents(s, d), head=HEAD)).select("id", "size", "hash", "n", "group_id")


@query("dup6_summary", f", {FUNNEL} SELECT count(*) AS sets, coalesce(sum(size * (n - 1)), 0) AS extra_bytes FROM sets")
def _(s, d):
    return duplicates.summary(duplicates.groups(duplicates.with_hashes(c.derived(s, d, annotated=False), contents(s, d), head=HEAD)))


@query(
    "dup7_shared_folders",
    f""", {FUNNEL}, members AS (SELECT id, group_id, string_split('/base/' || dir, '/') AS parts FROM full_hash JOIN sets USING (hash, size) JOIN (SELECT id, dir FROM cat) USING (id)),
m AS (SELECT group_id, min(len(parts)) AS shortest FROM members GROUP BY group_id), k AS (SELECT group_id, unnest(range(shortest)) AS pos, shortest FROM m),
same AS (SELECT k.group_id, k.pos, k.shortest, count(DISTINCT parts[k.pos + 1]) AS kinds FROM k JOIN members USING (group_id) GROUP BY ALL),
shared AS (SELECT group_id, coalesce(min(pos) FILTER (kinds > 1), min(shortest) - 1) AS shared FROM same GROUP BY group_id)
SELECT id, group_id, shared, CASE WHEN shared > 1 THEN array_to_string(parts[shared + 1:], '/') END AS folder FROM members JOIN shared USING (group_id)""",
)
def _(s, d):
    cat = c.derived(s, d, annotated=False)
    sets = duplicates.groups(duplicates.with_hashes(cat, contents(s, d), head=HEAD))
    return duplicates.shared_folders(sets, cat.select("id", F.concat(F.lit("/base/"), "dir").alias("dir")))


# --- annotations


@query("ann1_clean_names", r"SELECT id, CASE WHEN trim(regexp_replace('  ' || substr(text, 1, 60) || E'\n', '\s+', ' ', 'g')) <> '' THEN substr(trim(regexp_replace('  ' || substr(text, 1, 60) || E'\n', '\s+', ' ', 'g')), 1, 40) END AS name FROM cat")
def _(s, d):
    raw = F.concat(F.lit("  "), F.substring("text", 1, 60), F.lit("\n"))
    return c.table(s, d, "documents").select(F.col("doc_id").alias("id"), annotations.clean_name(raw).alias("name"))


@query(
    "ann2_create_tags",
    """, asked AS (SELECT lower('Lang ' || source) AS key, min('Lang ' || source) AS name, min(doc_id) AS seq FROM documents GROUP BY 1 UNION ALL SELECT 'quality', 'QUALITY', -1), new AS (SELECT name, row_number() OVER (ORDER BY seq) AS nth FROM asked WHERE key NOT IN (SELECT lower(name) FROM tags))
SELECT id, name, color, false AS created FROM tags WHERE lower(name) IN (SELECT key FROM asked) UNION ALL SELECT (SELECT max(id) FROM tags) + nth, name, ['brick', 'slate', 'moss', 'ochre', 'plum', 'teal', 'graphite'][((SELECT count(*) FROM tags) + nth - 1) % 7 + 1], true FROM new""",
)
def _(s, d):
    asked = c.table(s, d, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("Lang  "), "source").alias("name"))
    return annotations.create_tags(c.tags(s, d), asked.unionByName(s.createDataFrame([(-1, " QUALITY ")], "seq long, name string")))


@query("ann3_ann4_edit_tags", "SELECT id, CASE WHEN id = 2 THEN 'Good' ELSE name END AS name, CASE WHEN id = 2 THEN 'teal' ELSE color END AS color, CASE WHEN id = 2 THEN 'updated' WHEN id = 3 THEN 'duplicate name' WHEN id = 4 THEN 'unknown colour' ELSE 'kept' END AS outcome, (SELECT count(*) FROM file_tags WHERE tag_id = t.id) AS n FROM tags t WHERE id <> 1")
def _(s, d):
    edits = s.createDataFrame([(2, " Good ", "teal"), (3, "toxic", "plum"), (4, "Other", "pink")], "id long, name string, color string")
    left, bridge = annotations.delete_tag(annotations.update_tags(c.tags(s, d), edits), c.file_tags(s, d), 1)
    return aggregates.tag_usage(left, bridge)


@query("ann5_tag_edits", "SELECT file_id, tag_id FROM file_tags WHERE NOT (tag_id = 2 AND file_id % 2 = 0) UNION SELECT doc_id, 1 FROM documents WHERE doc_id % 5 = 0")
def _(s, d):
    t = c.file_tags(s, d)
    off = t.filter("tag_id = 2 AND file_id % 2 = 0").select(F.lit(2).cast("long").alias("seq"), "file_id", "tag_id", F.lit(False).alias("on"))
    first_on = off.select(F.lit(1).cast("long").alias("seq"), "file_id", "tag_id", F.lit(True).alias("on"))
    on = c.table(s, d, "documents").filter("doc_id % 5 = 0").select(F.lit(3).cast("long").alias("seq"), F.col("doc_id").alias("file_id"), F.lit(1).cast("long").alias("tag_id"), F.lit(True).alias("on"))
    return annotations.set_tags(t, first_on.unionByName(off).unionByName(on).unionByName(on))


@query("ann6_favourite_edits", "SELECT id, CASE WHEN id % 4 = 0 THEN true WHEN id % 4 = 1 THEN false ELSE is_favourite END AS is_favourite FROM cat")
def _(s, d):
    cat = c.derived(s, d)
    edit = lambda seq, when, on: cat.filter(when).select(F.lit(seq).cast("long").alias("seq"), "id", F.lit(on).alias("on"))
    return annotations.set_favourites(cat, edit(1, "id % 4 = 0", False).unionByName(edit(2, "id % 4 = 0", True)).unionByName(edit(3, "id % 4 = 1", False))).select("id", "is_favourite")


@query("ann7_opens", "SELECT id, 2 * open_count AS open_count, last_opened_at + 5 AS last_opened_at FROM cat")
def _(s, d):
    later = c.opens(s, d).withColumn("at", F.col("at") + 5)
    return annotations.record_opens(c.derived(s, d), later).select("id", "open_count", "last_opened_at")


# --- scalar display functions


@query(
    "fmt_sizes_and_ages",
    f"""SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 10 * 1024 THEN printf('%.1f', round(size / 1024, 1)) || ' KB' ELSE CAST(floor(size / 1024 + 0.5) AS BIGINT) || ' KB' END AS shown,
CASE WHEN modified_at = {NOW} THEN 0 WHEN {NOW} - modified_at < 2592000000 THEN CAST((modified_at - {NOW}) / 86400000 AS BIGINT) END AS age, CASE WHEN modified_at = {NOW} THEN 'now' WHEN {NOW} - modified_at < 2592000000 THEN 'day' ELSE 'date' END AS unit FROM cat""",
)
def _(s, d):
    age = text.relative_time(F.col("modified_at"), NOW)
    return c.derived(s, d, annotated=False).select("id", text.human_size(F.col("size")).alias("shown"), age["value"].alias("age"), age["unit"].alias("unit"))
