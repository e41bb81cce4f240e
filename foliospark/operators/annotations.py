"""Tags, favourites and opens as batches of edits. Within a batch the edit with the largest seq decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The palette, in the order in which new tags take its colours.
COLORS = ("brick", "slate", "moss", "ochre", "plum", "teal", "graphite")
MAX_NAME = 40


def clean_name(name: Column) -> Column:
    """White space as single spaces, at most 40 characters; null if nothing is left."""
    one = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(one != "", F.substring(one, 1, MAX_NAME))


def create_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """id, name, color, created of the tags that the names (seq, name) stand for: existing ones (whatever the case) or new ones, numbered in order, with the palette's next colours."""
    asked = names.select("seq", clean_name(F.col("name")).alias("name")).filter("name IS NOT NULL").withColumn("key", F.lower("name")).groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))
    old = tags.withColumn("key", F.lower("name"))
    found = asked.select("key").join(old, "key").select("id", "name", "color", F.lit(False).alias("created"))
    count = tags.agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    nth = F.row_number().over(Window.orderBy("seq"))  # tags are made by hand
    new = asked.join(old, "key", "left_anti").withColumn("nth", nth).crossJoin(count)
    color = F.element_at(F.array(*map(F.lit, COLORS)), ((F.col("n") + F.col("nth") - 1) % len(COLORS)).cast("int") + 1)
    return found.unionByName(new.select((F.col("last") + F.col("nth")).alias("id"), "name", color.alias("color"), F.lit(True).alias("created")))


def update_tags(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """tags after edits (id, name, color), with outcome: kept, updated, unknown colour, empty name, or duplicate name (of a tag with another id); rejected edits change nothing."""
    e = edits.select("id", clean_name(F.col("name")).alias("new_name"), F.col("color").alias("new_color"), F.lit(True).alias("edited"))
    joined = tags.join(e, "id", "left")
    taken = tags.select(F.col("id").alias("other"), F.lower("name").alias("key"))
    clash = joined.filter("edited").select("id", F.lower("new_name").alias("key")).join(taken, "key").filter("id <> other").select("id", F.lit(True).alias("clash")).distinct()
    outcome = F.when(F.col("edited").isNull(), "kept").when(F.col("new_name").isNull(), "empty name").when(~F.col("new_color").isin(*COLORS), "unknown colour").when(F.col("clash"), "duplicate name").otherwise("updated")
    out = joined.join(clash, "id", "left").withColumn("outcome", outcome)
    pick = lambda new, old: F.when(F.col("outcome") == "updated", F.col(new)).otherwise(F.col(old)).alias(old)
    return out.select("id", pick("new_name", "name"), pick("new_color", "color"), "outcome")


def delete_tag(tags: DataFrame, file_tags: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return tags.filter(F.col("id") != tag_id), file_tags.filter(F.col("tag_id") != tag_id)


def set_tags(file_tags: DataFrame, edits: DataFrame) -> DataFrame:
    """file_id, tag_id after edits (seq, file_id, tag_id, on)."""
    last = edits.groupBy("file_id", "tag_id").agg(F.max_by("on", "seq").alias("on"))
    both = file_tags.distinct().withColumn("had", F.lit(True)).join(last, ["file_id", "tag_id"], "full_outer")
    return both.filter(F.coalesce("on", "had")).select("file_id", "tag_id")


def set_favourites(catalog: DataFrame, edits: DataFrame) -> DataFrame:
    """catalog after edits (seq, id, on)."""
    last = edits.groupBy("id").agg(F.max_by("on", "seq").alias("_on"))
    return catalog.join(last, "id", "left").withColumn("is_favourite", F.coalesce("_on", "is_favourite")).drop("_on")


def record_opens(catalog: DataFrame, opened: DataFrame) -> DataFrame:
    """catalog with opens (file_id, at) added to open_count and last_opened_at."""
    new = opened.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    joined = catalog.join(new, "id", "left")
    return joined.withColumns({"open_count": F.col("open_count") + F.coalesce("_n", F.lit(0)), "last_opened_at": F.greatest("last_opened_at", "_at")}).drop("_n", "_at")
