"""Byte-identical documents by a funnel: size, hash of the head, hash of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import stored

HEAD = 64 * 1024
#: Ids that are sent to a scan at most (8 MB).
FEW = 1_000_000


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur at least twice. Keys are counted alone (partial counts first), contents aren't moved for it."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    return rows.join(twice, list(keys), "left_semi")


def candidates(catalog: DataFrame) -> DataFrame:
    """Documents with a size above 0 that another one has too."""
    return _shared(catalog.filter("size > 0"), "size")


def of_contents(contents: DataFrame, ids: DataFrame, value: Column, name: str) -> DataFrame:
    """id and a hash of the content of the documents ids (id; stored). It is taken where contents are scanned, so no content is moved: few ids are sent there and nothing else is read; many ids meet the hashes."""
    if ids.count() <= FEW:
        return contents.join(F.broadcast(ids), "id", "left_semi").select("id", value.alias(name))
    return contents.select("id", value.alias(name)).join(ids, "id", "left_semi")


def head_survivors(rows: DataFrame, contents: DataFrame, head: int = HEAD) -> DataFrame:
    """Of candidates (stored; with id and size): those that are small, or share size and head with another. Of the others the heads are read."""
    small, large = rows.filter(F.col("size") <= head), rows.filter(F.col("size") > head)
    heads = of_contents(contents, large.select("id"), F.sha2(F.substring(F.col("content"), 1, head), 256), "head_hash")
    marked = stored(large.join(heads, "id"), "heads")
    return small.unionByName(_shared(marked, "size", "head_hash").drop("head_hash"))


def with_hashes(rows: DataFrame, contents: DataFrame, cache: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """id, size, modified_at, hash of survivors of the funnel. contents: id, content. A cached hash (id, size, modified_at, hash) stands while size and time are the same; only the others are read whole."""
    rows = candidates(rows.select("id", "size", "modified_at"))
    cached = rows.withColumn("hash", F.lit(None).cast("string"))
    if cache is not None:
        old = cache.select("id", F.col("size").alias("s"), F.col("modified_at").alias("m"), "hash")
        cached = rows.join(old, "id", "left").select("id", "size", "modified_at", F.when(F.col("size").eqNullSafe(F.col("s")) & F.col("modified_at").eqNullSafe(F.col("m")), F.col("hash")).alias("hash"))
    survivors = stored(head_survivors(stored(cached, "candidates"), contents, head), "survivors")
    todo = survivors.filter("hash IS NULL")
    full = of_contents(contents, todo.select("id"), F.sha2("content", 256), "hash")
    return survivors.filter("hash IS NOT NULL").unionByName(todo.drop("hash").join(full, "id"))


def groups(hashed: DataFrame) -> DataFrame:
    """id, size, hash, modified_at, n, group_id: sets of two or more, numbered by size (largest first) and hash. Sets are sorted by ranges; a range's numbers go on from those before it."""
    order = (F.desc("size"), F.asc("hash"))
    sets = hashed.groupBy("hash", "size").agg(F.count("*").alias("n")).filter("n > 1")
    ranged = stored(sets.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "sets")
    before = F.coalesce(F.sum("of").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    starts = ranged.groupBy("range").agg(F.count("*").alias("of")).select("range", before.alias("before"))
    numbered = ranged.join(F.broadcast(starts), "range").withColumn("group_id", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))).cast("int"))
    return hashed.join(numbered.select("hash", "size", "n", "group_id"), ["hash", "size"])


def summary(grouped: DataFrame) -> DataFrame:
    """sets and extra_bytes, what all copies but one take."""
    one = grouped.groupBy("hash", "size").agg(F.count("*").alias("n"))
    return one.agg(F.count("*").alias("sets"), F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0)).alias("extra_bytes"))


def shared_folders(grouped: DataFrame, dirs: DataFrame) -> DataFrame:
    """id, group_id, shared (leading folders that all of a set have, one part at least staying), folder: what is left, only where more than one is shared. dirs: id, dir."""
    parts = grouped.select("id", "group_id").join(dirs, "id").withColumn("parts", F.split("dir", "/"))
    each = parts.select("group_id", "id", F.posexplode("parts").alias("at", "part"))
    size = parts.groupBy("group_id").agg(F.min(F.size("parts")).alias("shortest"), F.count("*").alias("members"))
    alike = each.groupBy("group_id", "at").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).join(size, "group_id").filter("n = members AND at < shortest - 1")
    first_other = alike.groupBy("group_id").agg(F.min(F.when(F.col("lo") != F.col("hi"), F.col("at"))).alias("stop"))
    shared = size.join(first_other, "group_id", "left").select("group_id", F.coalesce("stop", F.col("shortest") - 1).alias("shared"))
    rest = F.when(F.col("shared") > 1, F.array_join(F.slice("parts", F.col("shared") + 1, F.size("parts")), "/"))
    return parts.join(shared, "group_id").select("id", "group_id", "shared", rest.alias("folder"))
