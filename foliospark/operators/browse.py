"""Filtered, sorted and paged views of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import prefix_bounds

HOUR_MS = 3_600_000


def view(catalog: DataFrame, kind: str | None = None, modified_after: int | None = None, favourites: bool = False, opened: bool = False, tag_id: int | None = None, file_tags: DataFrame | None = None) -> DataFrame:
    """The rows that every given condition holds for."""
    rows = catalog
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if modified_after is not None:
        rows = rows.filter(F.col("modified_at") >= modified_after)
    if favourites:
        rows = rows.filter("is_favourite")
    if opened:
        rows = rows.filter("last_opened_at IS NOT NULL")
    if tag_id is not None:
        rows = rows.join(file_tags.filter(F.col("tag_id") == tag_id).select(F.col("file_id").alias("id")), "id", "left_semi")
    return rows


def sort_key(by: str, descending: bool) -> list[Column]:
    """by: modified, name, size or opened; then name and id. Missing values first when rising, last when falling."""
    key = {"modified": F.col("modified_at"), "name": F.lower("name"), "size": F.col("size"), "opened": F.col("last_opened_at")}[by]
    return [key.desc_nulls_last() if descending else key.asc_nulls_first(), F.lower("name"), F.col("id")]


def page(rows: DataFrame, order: list[Column], limit: int = 200, offset: int = 0) -> DataFrame:
    """The page's rows, by Spark's top-k; limits are brought into 1..1000 and offsets to 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def page_with_total(rows: DataFrame, order: list[Column], limit: int = 200, offset: int = 0) -> DataFrame:
    """The page and a column total, the number of all rows."""
    return page(rows, order, limit, offset).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def with_tags(rows: DataFrame, file_tags: DataFrame) -> DataFrame:
    """rows with tags, the sorted ids (empty without any)."""
    by = file_tags.groupBy(F.col("file_id").alias("id")).agg(F.sort_array(F.collect_set("tag_id")).alias("tags"))
    return rows.join(by, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<long>")))


def by_path(catalog: DataFrame, path: str) -> DataFrame:
    return catalog.filter(F.lower("path") == path.lower())


def under(catalog: DataFrame, folder: str) -> DataFrame:
    """Documents inside a folder. Where the catalog has a path_key (of keyed()), the bounds reach the scan."""
    low, high = prefix_bounds(folder)
    key = F.col("path_key") if "path_key" in catalog.columns else F.lower("path")
    return catalog.filter((key >= low) & (key < high))


def keyed(catalog: DataFrame) -> DataFrame:
    """With path_key, the lower-case path, in its order, to be written: files and row groups then cover few folders each."""
    return catalog.withColumn("path_key", F.lower("path")).repartitionByRange("path_key").sortWithinPartitions("path_key")


def details(catalog: DataFrame, texts: DataFrame, file_tags: DataFrame, excerpt: int = 1400) -> DataFrame:
    """Documents with tags, the first characters of their text and its status. texts: id, body."""
    return with_tags(catalog, file_tags).join(texts.select("id", F.substring("body", 1, excerpt).alias("excerpt")), "id", "left")


def preset(catalog: DataFrame, name: str, now_ms: int, kind: str | None = None, tag_id: int | None = None, file_tags: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """The rows and order of a named view: all, recent (30 days, by the hour), kind, opened, favourites, tag."""
    newest = sort_key("modified", True)
    if name == "recent":
        return view(catalog, modified_after=(now_ms - 30 * 24 * HOUR_MS) // HOUR_MS * HOUR_MS), newest
    if name == "opened":
        return view(catalog, opened=True), sort_key("opened", True)
    views = {"all": {}, "kind": {"kind": kind}, "favourites": {"favourites": True}, "tag": {"tag_id": tag_id, "file_tags": file_tags}}
    return view(catalog, **views[name]), newest


def visible_kinds(formats: DataFrame) -> DataFrame:
    """kind of those with at least one enabled extension. formats: ext, kind, enabled."""
    return formats.filter("enabled").select("kind").distinct()


