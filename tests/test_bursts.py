"""Bursts of events against a loop over them: in ranges of a table, and as a stream in several micro-batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliospark.streaming import bursts

GAPS = [(0, 1, 50, 299), (0, 10, 200, 300, 900), (1, 2, 3), (0, 0, 290), (5, 2000), (250,)]


def brute(events, quiet, limit):
    out, now = [], None
    for t, seq in sorted(events):
        if now is not None and (t - now[1] >= quiet or now[1] - now[0] >= limit):
            out.append(tuple(now))
            now = None
        now = [t, t, 1, seq, seq] if now is None else [now[0], t, now[2] + 1, min(now[3], seq), max(now[4], seq)]
    return {*out, tuple(now)} if now else set()


def events(seed, gaps, n=300):
    draw, t, out = random.Random(seed), 1_000_000, []
    for _ in range(n):
        t += draw.choice(gaps)
        out.append((t, draw.randrange(10**6)))
    return out


@pytest.mark.parametrize("gaps", GAPS)
def test_bursts_of_a_table(spark, gaps):
    rows = events(1, gaps)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        table = spark.createDataFrame([(seq, t) for t, seq in rows], "seq long, t long").select("seq", F.timestamp_millis("t").alias("ts"))
        found = bursts.bursts(table, 300, 2000)
        got = {(r["a"] // 1000, r["b"] // 1000, r["n"], r["first_seq"], r["last_seq"]) for r in found.select(F.unix_micros("first_ts").alias("a"), F.unix_micros("last_ts").alias("b"), "n", "first_seq", "last_seq").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == brute(rows, 300, 2000)
    assert "SinglePartition" not in found._jdf.queryExecution().toString()


def test_bursts_of_nothing(spark):
    assert bursts.bursts(spark.createDataFrame([], "seq long, ts timestamp")).count() == 0


def test_bursts_of_a_stream(spark, tmp_path):
    rows = [(root, t, seq) for root in "ab" for t, seq in events(ord(root), GAPS[1], 120)]
    rows.sort(key=lambda r: r[1])
    for low in range(0, len(rows), 60):
        part = spark.createDataFrame(rows[low : low + 60], "root string, t long, seq long").select("root", "seq", F.timestamp_millis("t").alias("ts"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for far in (10**7, 2 * 10**7):  # time passes
        spark.createDataFrame([(r, far, -1) for r in "ab"], "root string, t long, seq long").select("root", "seq", F.timestamp_millis("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("root string, seq long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write = bursts.live_bursts(stream, 300, 2000).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    write.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")).start().awaitTermination()
    got = {(r["root"], r["first_us"] // 1000, r["last_us"] // 1000, r["n"], r["first_seq"], r["last_seq"]) for r in spark.read.parquet(f"{tmp_path}/out").filter("first_seq <> -1").collect()}
    assert got == {(root, *x) for root in "ab" for x in brute([(t, seq) for r, t, seq in rows if r == root], 300, 2000)}
