from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.operators import segments

SCHEMA = "id long, body string"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def expected(texts):
    out = set()
    for i, body in texts.items():
        tokens = re.findall(r"[a-z0-9]+", body.lower())
        out |= {(i, w, tokens.count(w), tuple(p for p, x in enumerate(tokens) if x == w)) for w in tokens}
    return out


def found(spark, path):
    return {(r["id"], r["token"], r["tf"], tuple(r["positions"])) for r in segments.postings(spark, path).collect()}


def test_random_batches_against_a_dict(spark, tmp_path, monkeypatch):
    rng, path, held = random.Random(7), f"file://{tmp_path}/store", {}
    for number, size in enumerate((40, 3, 1, 9, 30)):
        monkeypatch.setattr(segments, "BROADCAST_IDS", number % 2 * 10**6)
        batch = {rng.randrange(60): None if rng.random() < 0.3 else " ".join(rng.choice(("Ash", "oak", "elm", "fir", "yew")) for _ in range(rng.randrange(6))) for _ in range(size)}
        assert segments.apply(spark, path, spark.createDataFrame(list(batch.items()), SCHEMA), number)
        held = {i: b for i, b in {**held, **batch}.items() if b is not None}
        assert {(r["id"], r["body"]) for r in segments.texts(spark, path).collect()} == set(held.items())
    assert found(spark, path) == expected(held)
    assert len(segments.manifest(spark, path)) <= 3
    assert segments.vacuum(spark, path) and not segments.vacuum(spark, path)
    assert found(spark, path) == expected(held)


def test_other_segments_files_stay_and_retries_do_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert segments.postings(spark, path) is None and segments.texts(spark, path) is None and segments.vacuum(spark, path) == []
    segments.apply(spark, path, spark.createDataFrame([(i, f"word{i} common") for i in range(20)], SCHEMA), 0)
    before = files(f"{tmp_path}/store/segments")
    change = spark.createDataFrame([(3, "new text"), (4, None), (5, None), (5, "a"), (5, "b"), (None, "lost"), (6, "")], SCHEMA)
    assert segments.apply(spark, path, change, 1)
    after = files(f"{tmp_path}/store/segments")
    assert before.items() <= after.items() and {f.split("/segments/")[1].split("/")[0] for f in set(after) - set(before)} == {f"b{1:020d}"}
    held = {i: f"word{i} common" for i in range(20) if i != 4} | {3: "new text", 5: "b", 6: ""}
    assert found(spark, path) == expected(held) and segments.texts(spark, path).count() == 19
    assert not segments.apply(spark, path, change.limit(0), 1) and files(f"{tmp_path}/store/segments") == after
    assert segments.apply(spark, path, change.limit(0), 2) and found(spark, path) == expected(held)


def test_a_batch_that_failed_half_way_is_run_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    segments.apply(spark, path, spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], SCHEMA), 0)
    change = spark.createDataFrame([(1, "uno")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(segments.versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            segments.apply(spark, path, change, 1)
    assert found(spark, path) == expected({1: "one", 2: "two", 3: "three"})
    assert segments.apply(spark, path, change, 1)
    assert found(spark, path) == expected({1: "uno", 2: "two", 3: "three"})


def test_tokens_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    segments.apply(spark, path, spark.createDataFrame([(1, "one"), (2, "two")], SCHEMA), 0)
    plan = segments.postings(spark, path).filter("token = 'two'")._jdf.queryExecution().toString()
    assert "EqualTo(token,two)" in plan


def test_a_batch_makes_its_postings_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(body):
        seen.add(1)
        return body

    made = segments.postings_of
    segments.postings_of = lambda texts: made(texts.withColumn("body", counted("body")))
    try:
        segments.apply(spark, f"{tmp_path}/store", spark.createDataFrame([(i, f"tern gull {i}") for i in range(12)], "id long, body string"), 0)
    finally:
        segments.postings_of = made
    assert seen.value == 12
    assert segments.postings(spark, f"{tmp_path}/store").filter("token = 'tern'").count() == 12
