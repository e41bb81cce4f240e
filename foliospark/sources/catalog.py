"""Tables of documents: from a folder of files, and the catalog that is derived from a corpus table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import EXTENSIONS, extension, is_enabled, is_lock_file, kind_of
from ..functions.paths import parent

#: The moment that recency is measured from in the derived tables.
NOW_MS = 1_706_745_600_000
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive listing of a folder: path, size, modified_at. Contents are not read: the column is pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "%20", " ")
    return files.select(path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))


def to_records(listing: DataFrame, disabled: tuple[str, ...] = (), opted_in: tuple[str, ...] = ()) -> DataFrame:
    """Observed files (path, size, modified_at) as documents: name, ext, kind, dir; other files, disabled formats and lock files are dropped."""
    rows = listing.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("ext", extension(F.col("name"))).withColumn("dir", parent(F.col("path")))
    return rows.filter(is_enabled(F.col("ext"), disabled, opted_in) & ~is_lock_file(F.col("name"))).withColumn("kind", kind_of(F.col("ext")))


def derived(spark: SparkSession, sf_dir: str, annotated: bool = True) -> DataFrame:
    """The catalog that stands for the documents table: a path, kind, times and content state for each document, favourites from labels, opens from events."""
    d = table(spark, sf_dir, "documents")
    names = list(EXTENSIONS)
    low = F.lower("text")
    first, second = (F.regexp_extract(low, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)(?:[^\p{L}\p{N}]+([\p{L}\p{N}]+))?", k) for k in (1, 2))
    ext = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names)).cast("int") + 1)
    rows = d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(second, F.lit("")), F.lit(" "), F.col("doc_id"), F.lit("."), ext).alias("name"),
        ext.alias("ext"),
        F.concat(F.lit("/data/"), "lang").alias("root"),
        F.concat(F.lit("/data/"), "lang", F.lit("/"), "source").alias("dir"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(NOW_MS) - (F.col("doc_id") * 7919 % 800) * DAY_MS).alias("modified_at"),
        F.when(F.col("doc_id") % 5 == 0, 0).when(F.col("doc_id") % 7 == 0, 2).when(F.col("doc_id") % 11 == 0, 3).otherwise(1).alias("content_status"),
    ).withColumn("kind", kind_of(F.col("ext"))).withColumn("path", F.concat("dir", F.lit("/"), "name"))
    if not annotated:
        return rows
    good = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") == 1).alias("is_favourite"))
    opened = opens(spark, sf_dir).groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("open_count"), F.max("at").alias("last_opened_at"))
    rows = rows.join(good, "id", "left").join(opened, "id", "left")
    return rows.withColumns({"is_favourite": F.coalesce("is_favourite", F.lit(False)), "open_count": F.coalesce("open_count", F.lit(0))})


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, at (ms), seq: the view events."""
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return e.select(F.col("user_id").alias("file_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, enabled: a location for each language (few rows), French paused."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    return langs.select(F.row_number().over(Window.orderBy("lang")).cast("long").alias("id"), F.concat(F.lit("/data/"), "lang").alias("path"), (F.col("lang") != "fr").alias("enabled"))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern: bare names and path rules made from the sources' names, as a user would write them."""
    s = table(spark, sf_dir, "documents").select("source", F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("n")).distinct()
    pattern = F.when(F.col("n") % 7 == 0, F.upper("source")).when(F.col("n") % 7 == 1, F.concat(F.lit(" /data/EN/"), "source", F.lit("/ "))).when(F.col("n") % 7 == 2, F.lit("/"))
    return s.select(pattern.alias("pattern")).filter("pattern IS NOT NULL")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, color: toxic, quality and the languages."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct().select((F.row_number().over(Window.orderBy("lang")) + 2).cast("long").alias("id"), F.concat(F.lit("Lang "), "lang").alias("name"), F.lit("moss").alias("color"))
    fixed = langs.sparkSession.createDataFrame([(1, "Toxic", "brick"), (2, "Quality", "slate")], "id long, name string, color string")
    return fixed.unionByName(langs)


def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, tag_id."""
    labels = table(spark, sf_dir, "labels")
    both = labels.filter("toxic = 1").select(F.col("doc_id").alias("file_id"), F.lit(1).cast("long").alias("tag_id")).unionByName(labels.filter("quality = 1").select(F.col("doc_id").alias("file_id"), F.lit(2).cast("long").alias("tag_id")))
    named = tags(spark, sf_dir).filter("id > 2").select(F.col("id").alias("tag_id"), F.substring("name", 6, 100).alias("lang"))
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang").join(F.broadcast(named), "lang").select("file_id", "tag_id")
    return both.unionByName(langs).distinct()


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: the first two words of each benchmark passage."""
    w = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.filter(w, lambda x: x != ""), 1, 2), " ").alias("text"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing of the same documents: some are gone, grown, or renamed by case, and some are new."""
    c = derived(spark, sf_dir, annotated=False).select("id", "path", "name", "ext", "kind", "dir", "root", "size", "modified_at").filter("id % 10 <> 3")
    grown = F.when(F.col("id") % 7 == 1, F.col("size") + 1).otherwise(F.col("size"))
    name = F.when(F.col("id") % 11 == 2, F.upper("name")).otherwise(F.col("name"))
    seen = c.select("id", name.alias("name"), "ext", "kind", "dir", "root", grown.alias("size"), "modified_at")
    new = c.filter("id % 13 = 5").select("id", F.concat(F.lit("new "), "name").alias("name"), "ext", "kind", "dir", "root", "size", "modified_at")
    return seen.unionByName(new).drop("id").withColumn("path", F.concat("dir", F.lit("/"), "name"))
