from __future__ import annotations

import os
import time

from foliospark.operators import isolation


def careless(files):
    def read(batches):
        for b in batches:
            for what in b["content"]:
                if what == b"kills":
                    os._exit(3)
                if what == b"never ends":
                    while True:
                        time.sleep(0.1)
                if what == b"breaks":
                    raise ValueError(what)
            yield b.assign(status=1, text=[bytes(x).decode() for x in b["content"]])[["id", "status", "text"]]

    return files.mapInPandas(read, "id long, status int, text string")


def test_bad_documents_fail_alone(spark):
    bad = {3: b"kills", 5: b"never ends", 10: b"breaks"}
    rows = [(i, bad.get(i, b"text %d" % i)) for i in range(12)]
    got = isolation.extract(spark.createDataFrame(rows, "id long, content binary"), careless, seconds=0.2, start=6, group=6)
    assert sorted(map(tuple, got.collect())) == [(i, 3, None) if i in bad else (i, 1, f"text {i}") for i in range(12)]


def test_without_documents(spark):
    got = isolation.extract(spark.createDataFrame([], "id long, content binary"), careless)
    assert got.count() == 0 and got.columns == ["id", "status", "text"]


def test_jobs_of_a_bad_document_are_few(spark, monkeypatch):
    ran, real = [], isolation._within
    monkeypatch.setattr(isolation, "_within", lambda result, to, limit: (ran.append((to, real(result, to, limit))), ran[-1][1])[1])
    rows = [(i, b"breaks" if i == 77 else b"text") for i in range(300)] + [(77, b"text")]
    got = isolation.extract(spark.createDataFrame(rows, "id long, content binary"), careless, group=400)
    assert sorted(map(tuple, got.collect())) == sorted((i, 3, None) if i == 77 else (i, 1, "text") for i in [*range(300), 77])
    assert sum(not ok for _, ok in ran) <= 7 and len(ran) <= 28


def one_by_one():
    def one(document):
        what = document["content"]
        if what == b"kills":
            os._exit(3)
        if what == b"never ends":
            while True:
                time.sleep(0.1)
        if what == b"breaks":
            raise ValueError(what)
        if what == b"exits":
            raise SystemExit
        if what == b"surrogate":
            return 1, "\ud800"
        print(what)
        return (2, None) if what is None else (1, bytes(what).decode())

    return one  # workers can't import this file


def test_bad_documents_cost_no_jobs(spark, monkeypatch):
    monkeypatch.setattr(isolation, "SENT_ROWS", 16)
    bad = {1: b"breaks", 2: b"kills", 3: b"exits", 4: b"surrogate", 17: b"\xff"}
    rows = [(i, b"never ends" if i == 55 else bad.get(i % 20, b"text %d" % i)) for i in range(300)] + [(None, b"kills"), (None, b"x"), (300, None)]
    spark.sparkContext.setJobGroup("one-by-one", "")
    try:
        got = isolation.each(spark.createDataFrame(rows, "id long, content binary").repartition(3), one_by_one(), seconds=2)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-by-one"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = [(i, 1, "text %d" % i) if i != 55 and i % 20 not in bad else (i, 3, None) for i in range(300)] + [(None, 3, None), (None, 1, "x"), (300, 2, None)]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert jobs <= 4


def test_each_without_documents(spark):
    assert isolation.each(spark.createDataFrame([], "id long, content binary"), one_by_one()).count() == 0
