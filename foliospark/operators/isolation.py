"""Reading documents with a reader that may fail, kill its worker or never end.

``each``: the reader is a function of one document and runs in a process of its own beside each task, so a bad document costs a new process and no job, however many there are. ``extract``: the reader is made of
DataFrame functions, which can only be run as jobs: groups are jobs of their own with a time limit, and a group that fails is cut in four until one document is left; it is meant for few bad documents.

In ``extract`` documents are dealt to groups by a hash of their id and written once; a job reads its group's folder alone. A document that fails by itself gets status 3 and no text, all others are read. Jobs overwrite
their own output, so that a lost executor costs a retry. Ids are unique; rows that share one fail together. A null id is a document like others; without documents there are no rows.
"""

from __future__ import annotations

import contextlib
import multiprocessing
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import shared_dir, small_batches, stored
from .extraction import FAILED

RESULT = "id long, status int, text string"
#: Documents of a group, and how many groups there are at most.
GROUP, MOST_GROUPS = 2000, 4096
#: Documents, and bytes of them, that a reader's process gets at once; what it hasn't read is sent again after a bad one.
SENT_ROWS, SENT_BYTES = 256, 1 << 20


def each(files: DataFrame, reader: Callable[[dict], tuple[int, str | None]], seconds: float = 20.0) -> DataFrame:
    """id, status, text of files (id and what the reader needs), stored. reader: status and text of one document, given as its columns by name.

    A document whose reader raises, ends its process or takes longer than seconds gets status 3 and no text; rows are read one by one, also those that share an id.
    """
    small_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Apart(reader, seconds) as apart:
            for b in batches:
                at = 0
                while at < b.num_rows:
                    n = max(1, min(SENT_ROWS, b.num_rows * SENT_BYTES // max(b.nbytes, 1)))
                    rows = b.slice(at, n).to_pylist()
                    got = apart.read(rows)
                    columns = ([r["id"] for r in rows], [x[0] for x in got], [x[1] for x in got])
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], ["id", "status", "text"])
                    at += n

    return stored(files.withColumn("id", F.col("id").cast("long")).mapInArrow(run, RESULT), "isolated")


class _Apart:
    """A reader in a process of its own, which is ended and started anew where a document takes too long or ends it."""

    def __init__(self, reader: Callable[[dict], tuple[int, str | None]], seconds: float) -> None:
        self.reader, self.seconds, self.child = reader, seconds, None

    def __enter__(self) -> _Apart:
        return self

    def __exit__(self, *_) -> None:
        if self.child is not None:
            self.pipe.close()
            self.child.kill()
            self.child.join()
            self.child = None

    def start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, other = context.Pipe()
        self.child = context.Process(target=_serve, args=(self.reader, other, self.pipe), daemon=True)
        self.child.start()
        other.close()

    def read(self, rows: list[dict]) -> list[tuple[int, str | None]]:
        out: list[tuple[int, str | None]] = []
        while len(out) < len(rows):
            if self.child is None:
                self.start()
            try:
                self.pipe.send(rows[len(out) :])
                while len(out) < len(rows):
                    if not self.pipe.poll(self.seconds):
                        raise TimeoutError
                    out.append(self.pipe.recv())
            except (OSError, EOFError):  # it was ended (a broken pipe), or takes too long (TimeoutError)
                out.append((FAILED, None))
                self.__exit__()
        return out


def _serve(reader: Callable[[dict], tuple[int, str | None]], pipe, parents) -> None:
    """Answers each document of the lists that come, until the other end is closed. What a reader prints must not reach the task's own streams."""
    parents.close()
    quiet = os.open(os.devnull, os.O_RDWR)
    os.dup2(quiet, 0)
    os.dup2(quiet, 1)
    with contextlib.suppress(EOFError, BrokenPipeError, KeyboardInterrupt):
        while True:
            for row in pipe.recv():
                try:
                    status, text = reader(row)
                    answer = int(status), None if text is None else str(text).encode().decode()
                except Exception:  # whatever a reader raises, its document failed
                    answer = FAILED, None
                pipe.send(answer)
    os._exit(0)


def extract(files: DataFrame, reader: Callable[[DataFrame], DataFrame], seconds: float = 20.0, start: float = 20.0, at_once: int = 4, group: int = GROUP) -> DataFrame:
    """id, status, text of files (id and what the reader needs). reader: returns these columns for some of the files, without moving rows between documents.

    A job may take ``start`` seconds and ``seconds`` for each round of its documents over the cluster's cores; a document alone start + seconds. at_once: jobs that run at the same time.
    """
    spark, here = files.sparkSession, f"{shared_dir(files.sparkSession)}/isolated-{uuid.uuid4().hex}"
    small_batches(spark)
    groups = min(MOST_GROUPS, -(-files.count() // group)) or 1
    dealt = files.withColumns({"_group": F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), "_bits": F.xxhash64("id", F.lit(1))})
    dealt.repartition("_group").write.partitionBy("_group").parquet(f"{here}/files")
    kept = spark.read.schema(dealt.schema).parquet(f"{here}/files")
    cores, columns = spark.sparkContext.defaultParallelism, [c for c in dealt.columns if c not in ("_group", "_bits")]
    alone: list[tuple[int, int]] = []  # group and bits of the documents that failed by themselves

    def attempt(number: int, level: int, part: int, n: int) -> list[tuple[int, int, int, int]]:
        """Runs a group of n rows; the quarters to try where it failed, with their rows counted."""
        rows = kept.filter((F.col("_group") == number) & (F.col("_bits").bitwiseAND(F.lit((1 << level) - 1)) == part))
        to = f"{here}/read/group={number}/level={level}/part={part}"
        result = reader(rows.repartition(min(n, cores), "_bits").select(*columns)).select(F.col("id").cast("long"), F.col("status").cast("int"), "text")
        if _within(result, to, start + seconds * -(-n // cores)):
            return []
        quarter = F.shiftrightunsigned("_bits", level).bitwiseAND(F.lit(3)).alias("quarter")
        found = rows.groupBy(quarter).agg(F.count("*").alias("n"), F.min("_bits").alias("low"), F.max("_bits").alias("high")).collect()  # four rows
        if level < 60 and (len(found) > 1 or found[0]["low"] != found[0]["high"]):
            return [(number, level + 2, part + (q["quarter"] << level), q["n"]) for q in found]
        alone.extend((number, bits) for bits in {q[c] for q in found for c in ("low", "high")})
        return []

    waiting = [(r["_group"], 0, 0, r["n"]) for r in kept.groupBy("_group").agg(F.count("*").alias("n")).collect()]  # MOST_GROUPS rows
    if not waiting:
        return spark.createDataFrame([], RESULT)
    with ThreadPoolExecutor(at_once) as pool:
        while waiting:
            waiting = [part for parts in pool.map(lambda w: attempt(*w), waiting) for part in parts]
    failed = spark.createDataFrame(alone, "_group int, _bits long")  # few, as each costs jobs of its own
    bad = kept.join(F.broadcast(failed), ["_group", "_bits"], "left_semi").select("id", F.lit(FAILED).alias("status"), F.lit(None).cast("string").alias("text"))
    bad.write.mode("overwrite").parquet(f"{here}/read/failed")
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(f"{here}/read")


def _within(result: DataFrame, to: str, limit: float) -> bool:
    """Writes the result; False if that failed or took longer than the limit. A worker that is busy then is killed with its task."""
    context, name = result.sparkSession.sparkContext, uuid.uuid4().hex
    context.setJobGroup(name, f"isolated documents to {to}", interruptOnCancel=True)
    timer = threading.Timer(limit, context.cancelJobGroup, [name])
    timer.start()
    try:
        result.write.mode("overwrite").parquet(to)
    except (Py4JError, PySparkException):
        return False
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    return True
