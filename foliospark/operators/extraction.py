"""Text extraction as a job over documents' bytes, and what surrounds it: queue, quarantine, publishing.

Plain formats are decoded by DataFrame functions. Office, OpenDocument, PDF and RTF files have no reader here and are skipped (status 2), so no text is lost silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import extension, reads_text
from ..functions.text import MAX_TEXT_CHARS, normalized

WAITING, READ, SKIPPED, FAILED = 0, 1, 2, 3
MAX_BYTES = 40 << 20
PLAIN = ("txt", "md", "csv")


def extract(files: DataFrame) -> DataFrame:
    """id, status, text of files (id, ext, content): read, or skipped (no reader for the format, no content, or more than 40 MiB; null text). Bytes that aren't UTF-8 become U+FFFD."""
    readable = F.coalesce(F.col("ext").isin(*PLAIN) & (F.length("content") <= MAX_BYTES), F.lit(False))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("id", F.when(readable, READ).otherwise(SKIPPED).alias("status"), F.when(readable, normalized(text)).alias("text"))


def from_folder(spark, folder: str) -> DataFrame:
    """path, ext, content of files up to 40 MiB; the size filter is pushed to the file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.col("length") <= MAX_BYTES).select("path", extension(F.col("path")).alias("ext"), "content")


#: A reference to a character by its number, decimal or hexadecimal.
NUMBERED = "&#([0-9]+|[xX][0-9a-fA-F]+);"


def numbered_decoded(text: Column) -> Column:
    """References by number as characters; those that name none (0, surrogates, beyond U+10FFFF) stay as they are."""

    def char(ref: Column) -> Column:
        digits = F.when(F.rlike(ref, F.lit("^[xX]")), F.conv(F.regexp_replace(ref, "^[xX]0*", ""), 16, 10)).otherwise(F.regexp_replace(ref, "^0+", ""))
        code = F.when(F.length(digits) <= 7, F.try_to_number(digits, F.lit("9999999")).cast("long"))
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.concat(F.lit("&#"), ref, F.lit(";")))

    chars = F.transform(F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1)), char)
    joined = F.zip_with(F.split(text, NUMBERED, -1), chars, lambda part, c: F.concat(part, F.coalesce(c, F.lit(""))))
    return F.when(F.rlike(text, F.lit(NUMBERED)), F.array_join(joined, "")).otherwise(text)


def markup_to_text(html: Column, cap: int = MAX_TEXT_CHARS) -> Column:
    """Tags dropped, a space at the end of p, h, tr, tc, br and at br, tab, s, line-break, the five named entities and references by number decoded, then normalised."""
    spaced = F.regexp_replace(html, r"(?i)</(?:[a-z0-9]+:)?(?:p|h|tr|tc|br)\s*>|<(?:[a-z0-9]+:)?(?:br|tab|s|line-break)\b[^>]*/>", " ")
    bare = F.regexp_replace(spaced, r"(?s)<!--.*?-->|<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return normalized(F.replace(numbered_decoded(bare), F.lit("&amp;"), F.lit("&")), cap)


def queue(catalog: DataFrame, most: int | None = None) -> DataFrame:
    """Documents whose text waits to be read, newest first."""
    rows = catalog.filter((F.col("content_status") == WAITING) & reads_text(F.col("ext"))).orderBy(F.col("modified_at").desc_nulls_last(), "id")
    return rows if most is None else rows.limit(most)


def pending(catalog: DataFrame) -> DataFrame:
    return catalog.filter((F.col("content_status") == WAITING) & reads_text(F.col("ext"))).agg(F.count("*").alias("pending"))


def begin(jobs: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Before a run: (jobs to read, attempts to write). A document that two runs in a row began and didn't finish is failed for good. attempts: id, n (unfinished runs so far)."""
    counted = jobs.select("id").join(attempts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    bad = counted.filter("n >= 2").select("id")
    return jobs.join(bad, "id", "left_anti"), counted.select("id", F.when(F.col("n") < 2, F.col("n") + 1).otherwise(F.col("n")).alias("n"))


def quarantined(attempts: DataFrame, most: int = 2) -> DataFrame:
    return attempts.filter(F.col("n") >= most).select("id", F.lit(FAILED).alias("status"))


def finished(attempts: DataFrame, done: DataFrame) -> DataFrame:
    """Documents that were read, skipped or failed cleanly lose their count."""
    return attempts.join(done.select("id"), "id", "left_anti")


def publish(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """catalog with content_status set where size and modified_at are still those that were read. results: id, size, modified_at, status."""
    r = results.select("id", F.col("size").alias("_s"), F.col("modified_at").alias("_m"), F.col("status").alias("_status"))
    still = F.col("_status").isNotNull() & F.col("size").eqNullSafe(F.col("_s")) & F.col("modified_at").eqNullSafe(F.col("_m"))
    return catalog.join(r, "id", "left").withColumn("content_status", F.when(still, F.col("_status")).otherwise(F.col("content_status"))).drop("_s", "_m", "_status")
