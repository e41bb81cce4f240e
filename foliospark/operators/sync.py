"""Bringing a catalog in step with a listing: one full outer join by lower-case path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot(catalog: DataFrame, root_id: int | None = None) -> DataFrame:
    """path_key, id, name, size, modified_at of one root's documents (or all)."""
    rows = catalog if root_id is None else catalog.filter(F.col("root_id") == root_id)
    return rows.select(F.lower("path").alias("path_key"), "id", "name", "size", "modified_at")


def diff(known: DataFrame, listing: DataFrame) -> DataFrame:
    """path_key, id, change: unchanged, updated (size, time or name differ), added, gone. known: of snapshot()."""
    seen = listing.select(F.lower("path").alias("path_key"), F.col("name").alias("new_name"), F.col("size").alias("new_size"), F.col("modified_at").alias("new_modified_at"), F.lit(True).alias("seen"))
    both = known.join(seen, "path_key", "full_outer")
    same = F.col("size").eqNullSafe(F.col("new_size")) & F.col("modified_at").eqNullSafe(F.col("new_modified_at")) & F.col("name").eqNullSafe(F.col("new_name"))
    change = F.when(F.col("id").isNull(), "added").when(F.col("seen").isNull(), "gone").when(same, "unchanged").otherwise("updated")
    return both.select("path_key", "id", change.alias("change"))


def _fresh(prefix: str) -> Column:
    """Size and time are still those of the new row."""
    return F.col("c.size").eqNullSafe(F.col(f"{prefix}.size")) & F.col("c.modified_at").eqNullSafe(F.col(f"{prefix}.modified_at"))


def upsert_on_path(catalog: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """Rows whose path is known refresh root, size, times; content_status and hash are kept only if size and time are the same; name, ext, kind and dir stay. Others are new, with id null (the writer numbers them)."""
    new = rows.withColumn("path_key", F.lower("path")).alias("n")
    old = catalog.withColumn("path_key", F.lower("path")).alias("c")
    fresh = _fresh("n")
    hit = old.join(new, "path_key").select(
        "c.id", "c.path", "c.name", "c.ext", "c.kind", "c.dir", "n.root_id", "n.size", "n.modified_at",
        F.when(fresh, F.col("c.content_status")).otherwise(0).alias("content_status"), F.when(fresh, F.col("c.hash")).alias("hash"), F.lit(now_ms).alias("last_seen_at"), F.lit("updated").alias("outcome"),
    )
    add = new.join(old.select("path_key"), "path_key", "left_anti").select(
        F.lit(None).cast("long").alias("id"), "n.path", "n.name", "n.ext", "n.kind", "n.dir", "n.root_id", "n.size", "n.modified_at", F.lit(0).alias("content_status"), F.lit(None).cast("string").alias("hash"), F.lit(now_ms).alias("last_seen_at"), F.lit("added").alias("outcome"),
    )
    return hit.unionByName(add)


def update_by_id(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """All columns of the listing are refreshed for the rows' ids; annotations stay; content_status and hash as in upsert_on_path."""
    fresh = _fresh("n")
    joined = catalog.alias("c").join(rows.alias("n"), "id")
    kept = [c for c in catalog.columns if c not in ("id", "path", "name", "ext", "kind", "dir", "size", "modified_at", "content_status", "hash")]
    return joined.select("id", *[F.col(f"n.{c}") for c in ("path", "name", "ext", "kind", "dir", "size", "modified_at")], F.when(fresh, F.col("c.content_status")).otherwise(0).alias("content_status"), F.when(fresh, F.col("c.hash")).alias("hash"), *[F.col(f"c.{c}") for c in kept])


def gone(known: DataFrame, listing: DataFrame, completed_roots: DataFrame) -> DataFrame:
    """id of documents not seen again, of roots that were walked to their end only. known: path, id, root_id."""
    walked = known.join(completed_roots.select("root_id"), "root_id", "left_semi").withColumn("path_key", F.lower("path"))
    return walked.join(listing.select(F.lower("path").alias("path_key")), "path_key", "left_anti").select("id")


def without_orphans(catalog: DataFrame) -> DataFrame:
    return catalog.filter("root_id IS NOT NULL")


def summary(changes: DataFrame) -> DataFrame:
    """found, added, updated, removed, of diff()'s rows."""
    count = lambda *names: F.count_if(F.col("change").isin(*names))
    return changes.agg(count("unchanged", "updated", "added").alias("found"), count("added").alias("added"), count("updated").alias("updated"), count("gone").alias("removed"))


def delete_ids(ids: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table without the rows whose id column names a deleted document: catalog, texts, postings, tags."""
    return {name: df.join(ids.select(F.col("id").alias(col)).distinct(), col, "left_anti") for name, (df, col) in tables.items()}
