"""Exact deduplication: group by a 128-bit content hash, verify the bytes, keep the smallest id.

Texts are equal when they are identical after each run of ASCII white space became one space.
Only keys travel in the first shuffle (16-byte hash, id); texts are moved for members of groups of two
or more alone, where they are aggregated by (hash, text), so copies collapse before the shuffle and a
group that holds a third of all rows is one partial row per task. Two texts that share a 128-bit hash fall into
different classes there. The tables of repeated hashes and of groups are broadcast while they are small (their rows are counted), so texts then aren't
shuffled to be matched with them.

Edge cases: a null text counts as empty; null ids sort after all others, a group of null ids only keeps a null id;
rows that share the kept id are told apart by a hash of the whole row, and rows alike in every column are all marked
kept by ``mark`` while ``drop`` returns one of them; an empty table gives an empty table; input columns named like an
output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored, text_of, without

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space. Single spaces, the bulk, are left untouched by the pattern."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    norm = normalised(text_of(text_col)).cast("binary")
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    return docs.select(F.struct(*without(docs, *ADDED)).alias("row"), F.col(f"`{id_col}`").alias("id"), row.alias("row_hash"), norm.alias("norm")).withColumn("key", F.unhex(F.md5("norm")))


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per distinct text that occurs at least twice: key, sha (of the text), id and row_hash of the row that stays, group_size."""
    keys = _keyed(docs, text_col, id_col).select("key")
    repeated = sized(stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated"))
    members = _keyed(docs, text_col, id_col).select("key", "norm", "id", "row_hash").join(repeated, "key", "left_semi")
    rep = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_hash"))
    return members.groupBy("key", "norm").agg(rep.alias("rep"), F.count("*").alias("group_size")).select("key", F.sha2("norm", 256).alias("sha"), "rep.id", "rep.row_hash", "group_size")


def _joined(docs: DataFrame, text_col: str, id_col: str, found: DataFrame) -> DataFrame:
    found = sized(found.select("key", "sha", F.struct("id", "row_hash", "group_size").alias("rep")))
    rows = _keyed(docs, text_col, id_col).withColumn("sha", F.sha2("norm", 256)).drop("norm")
    same = F.col("rep.id").eqNullSafe(F.col("id")) & (F.col("rep.row_hash") == F.col("row_hash"))
    return rows.join(found, ["key", "sha"], "left").withColumn("kept", F.col("rep").isNull() | same)


def mark(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of docs, and keep_id, group_size (long), kept (boolean), text_sha256 (of the normalised text)."""
    rows = _joined(docs, text_col, id_col, stored(classes(docs, text_col, id_col), "classes"))
    return rows.select(
        "row.*",
        F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("rep.id")).alias("keep_id"),
        F.coalesce(F.col("rep.group_size"), F.lit(1)).cast("long").alias("group_size"),
        "kept",
        F.col("sha").alias("text_sha256"),
    )


def drop(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without all but one row of each group of equal texts."""
    rows = _joined(docs, text_col, id_col, stored(classes(docs, text_col, id_col), "classes")).filter("kept")
    one = rows.filter(F.col("rep").isNotNull()).groupBy("key", "sha").agg(F.first("row").alias("row"))
    return rows.filter(F.col("rep").isNull()).select("row.*").unionByName(one.select("row.*"))
