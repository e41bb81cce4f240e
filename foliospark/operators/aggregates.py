"""Counts and sizes of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import EXTENSIONS, is_enabled, reads_text


def totals(catalog: DataFrame) -> DataFrame:
    """One row: total, bytes, favourites, opened and by_kind, a map."""
    by = catalog.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_if("is_favourite").alias("fav"), F.count("last_opened_at").alias("opened"))
    pairs = F.sort_array(F.collect_list(F.struct("kind", "n")))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return by.agg(total("n", "total"), total("bytes", "bytes"), total("fav", "favourites"), total("opened", "opened"), F.map_from_entries(pairs).alias("by_kind"))


def by_kind(catalog: DataFrame) -> DataFrame:
    """kind, n, bytes and share, of all bytes."""
    rows = catalog.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return rows.withColumn("share", F.col("bytes") / F.sum("bytes").over(Window.partitionBy()))  # one row per kind


def count_by(catalog: DataFrame, column: str) -> DataFrame:
    """column and n, without the rows where it is null."""
    return catalog.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def largest(catalog: DataFrame, k: int = 12) -> DataFrame:
    return catalog.orderBy(F.desc("size"), "id").limit(k)


def formats(catalog: DataFrame, disabled: tuple[str, ...] = (), opted_in: tuple[str, ...] = ()) -> DataFrame:
    """All known extensions: ext, kind, enabled, n (0 without documents), readable."""
    known = catalog.sparkSession.createDataFrame(list(EXTENSIONS.items()), "ext string, kind string")
    found = known.join(count_by(catalog, "ext"), "ext", "left")
    return found.select("ext", "kind", is_enabled(F.col("ext"), disabled, opted_in).alias("enabled"), F.coalesce("n", F.lit(0)).alias("n"), reads_text(F.col("ext")).alias("readable"))


def overview(catalog: DataFrame, roots: DataFrame, disabled: tuple[str, ...] = (), opted_in: tuple[str, ...] = ()) -> DataFrame:
    """One row: total, bytes, favourites, opened, pending (texts that wait), active_roots, disabled_formats."""
    off = sorted(e for e in EXTENSIONS if e in disabled or (e in ("txt", "md") and e not in opted_in))
    pending = catalog.agg(F.count_if((F.col("content_status") == 0) & reads_text(F.col("ext"))).alias("pending"))
    active = roots.agg(F.count_if("enabled").alias("active_roots"))
    return totals(catalog).drop("by_kind").crossJoin(pending).crossJoin(active).withColumn("disabled_formats", F.lit(",".join(off)))  # rows of one


def tag_usage(tags: DataFrame, file_tags: DataFrame) -> DataFrame:
    """All tags with n, the documents that have them, by name whatever the case."""
    used = file_tags.distinct().groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("n"))
    return tags.join(used, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.lower("name"), "id")


def root_inventory(roots: DataFrame, catalog: DataFrame) -> DataFrame:
    return roots.join(count_by(catalog, "root_id").withColumnRenamed("root_id", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def tiles(catalog: DataFrame) -> DataFrame:
    """kind, n, bytes, exts: the extensions present, sorted."""
    return catalog.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("exts"))
