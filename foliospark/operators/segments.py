"""A text store that batches keep up to date: each writes a segment of its own texts and postings, and the files of other segments stay as they are.

A segment is a folder with three tables: ``texts`` (id, body, n_tokens), ``postings`` (id, token, tf, positions; each file in token order) and ``touched`` (id: all that its batch set or cleared). A document is
read from the newest segment that touched it; older ones' rows of it are dead. The table of segments is versioned by batch number, so a batch that is run again does nothing, and one
that fails leaves the store as it was. Whenever the newer segments together are as large as the one before them, all of these become one segment: n documents lie in about log2(n) segments at
most, and a posting is written again about as often.

Edge cases: null ids are left out; of a batch's rows of one id the largest body stays, and a null one only where there is no other; an empty text is a document without tokens; an empty batch is a
segment without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded, words
from ..sources.work import SENT_IDS, file_system
from . import versions
from .index import postings as postings_of

MANIFEST = "segment string, first long, last long, docs long, touched long"
#: Up to so many ids of newer segments are sent to the scan of the others; beyond, both are shuffled by id.
BROADCAST_IDS = SENT_IDS


def manifest(spark: SparkSession, path: str) -> list[tuple]:
    """(segment, first, last, docs, touched), oldest first: the batches that a segment holds, its texts, and the ids that it hides in older ones. About log2(n) rows."""
    table = versions.current(spark, f"{path}/manifest")
    return [] if table is None else sorted((tuple(r) for r in table.collect()), key=lambda r: r[1])


def _write(spark: SparkSession, path: str, name: str, texts: DataFrame, touched: DataFrame, postings: DataFrame | None) -> tuple[int, int]:
    """Writes a segment and counts its texts and ids. postings: None makes them from the texts; they are dealt by token, as ranges would make them twice."""
    to = f"{path}/segments/{name}"
    texts.write.mode("overwrite").parquet(f"{to}/texts")
    touched.write.mode("overwrite").parquet(f"{to}/touched")
    made = postings_of(spark.read.parquet(f"{to}/texts")) if postings is None else postings
    made.repartition("token").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{to}/postings")
    return spark.read.parquet(f"{to}/texts").count(), spark.read.parquet(f"{to}/touched").count()


def _live(spark: SparkSession, path: str, segments: list[tuple], part: str) -> DataFrame:
    """A table's rows that no newer one of the segments hides, with _nth, their segment's place."""
    read = [spark.read.parquet(f"{path}/segments/{s[0]}/{part}").withColumn("_nth", F.lit(i)) for i, s in enumerate(segments)]
    rows = read[0]
    for r in read[1:]:
        rows = rows.unionByName(r)
    if len(segments) == 1:
        return rows
    hidden = [spark.read.parquet(f"{path}/segments/{s[0]}/touched").withColumn("_by", F.lit(i)) for i, s in enumerate(segments) if i]  # nothing is older than the first
    ids = hidden[0]
    for h in hidden[1:]:
        ids = ids.unionByName(h)
    newest = ids.groupBy("id").agg(F.max("_by").alias("_by"))
    if sum(s[4] for s in segments[1:]) <= BROADCAST_IDS:
        newest = F.broadcast(newest)
    return rows.join(newest, "id", "left").filter("_by IS NULL OR _nth >= _by").drop("_by")


def apply(spark: SparkSession, path: str, changed: DataFrame, number: int) -> bool:
    """Sets or clears (null body) the texts of changed (id, body) as batch number, which rises from one batch to the next. False if it was applied before."""
    done = manifest(spark, path)
    if done and done[-1][2] >= number:
        return False
    one = changed.filter("id IS NOT NULL").groupBy("id").agg(F.max("body").alias("body"))
    name = f"b{number:020d}"
    staged = f"{path}/segments/{name}/changed"  # read twice: for texts and for ids
    one.write.mode("overwrite").parquet(staged)
    one = spark.read.schema(one.schema).parquet(staged)
    live = one.filter("body IS NOT NULL").withColumn("n_tokens", F.size(words(folded(F.col("body")))))
    docs, touched = _write(spark, path, name, live, one.select("id"), None)
    _remove(spark, staged)
    segments = [*done, (name, number, number, docs, touched)]
    merged = _merged(spark, path, segments)
    versions.commit(spark.createDataFrame(merged, MANIFEST).coalesce(1), f"{path}/manifest", number)
    return True


def _merged(spark: SparkSession, path: str, segments: list[tuple]) -> list[tuple]:
    """The segments after the newest ones became one, where they together are as large as the one before them."""
    at, size = len(segments) - 1, max(segments[-1][3:])
    while at and max(segments[at - 1][3:]) <= size:
        at -= 1
        size += max(segments[at][3:])
    run = segments[at:]
    if len(run) == 1:
        return segments
    name = f"m{run[0][1]:020d}-{run[-1][2]:020d}"
    ids = spark.read.parquet(*[f"{path}/segments/{s[0]}/touched" for s in run]).distinct()
    if at == 0:  # nothing is older: no id needs to be hidden any more
        ids = ids.limit(0)
    docs, touched = _write(spark, path, name, _live(spark, path, run, "texts").drop("_nth"), ids, _live(spark, path, run, "postings").drop("_nth"))
    return [*segments[:at], (name, run[0][1], run[-1][2], docs, touched)]


def texts(spark: SparkSession, path: str) -> DataFrame | None:
    """id, body, n_tokens; None before the first batch. Without body only ids and counts are read."""
    found = manifest(spark, path)
    return _live(spark, path, found, "texts").drop("_nth") if found else None


def postings(spark: SparkSession, path: str) -> DataFrame | None:
    """id, token, tf, positions; None before the first batch. A filter on token skips row groups in each segment."""
    found = manifest(spark, path)
    return _live(spark, path, found, "postings").drop("_nth") if found else None


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes the segments that the store doesn't read any more, once no reader of an older version is left; their names."""
    kept = {s[0] for s in manifest(spark, path)}
    fs, folder, _ = file_system(spark, f"{path}/segments")
    old = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in kept) if fs.exists(folder) else []
    for name in old:
        _remove(spark, f"{path}/segments/{name}")
    return old


def _remove(spark: SparkSession, path: str) -> None:
    fs, to, _ = file_system(spark, path)
    fs.delete(to, True)
