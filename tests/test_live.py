"""A catalog's current state from a stream: results don't depend on micro-batches, and a restart goes on where the last run ended."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliospark.streaming import live

SCHEMA = "root string, seq long, ts timestamp, kind string, path string, path_to string, size long, modified_at long"


def is_doc(path):
    return path is not None and path.endswith((".pdf", ".txt"))


def random_events(draw, n):
    """Events on few names in few folders, so that they meet."""
    folders = ["/r/a", "/r/b", "/r/a/in"]
    file = lambda: f"{draw.choice(folders)}/{draw.choice('xyz')}.{draw.choice(('pdf', 'pdf', 'tmp'))}"
    out, ts = [], 0
    for seq in range(n):
        ts += draw.choice((10, 300, 1500, 4000))
        kind = draw.choice(("create", "modify", "remove", "rename_both", "rename_from", "rename_to", "other", "folder"))
        path, to = file(), file() if kind == "rename_both" else None
        if kind == "folder":
            kind, path = draw.choice(("remove", "rename_both")), draw.choice(folders)
            to = "/r/" + draw.choice("cde") if kind == "rename_both" else None
        out.append({"seq": seq, "ts_ms": ts, "kind": kind, "path": path, "path_to": to, "size": draw.choice((5, 6)), "modified_at": 1, "is_doc": is_doc(path), "is_doc_to": is_doc(to)})
    return out


def run(events, borders):
    """Documents after the events, applied in micro-batches that end before the borders."""
    docs = {f"/r/a/{x}.pdf": (k, f"/r/a/{x}.pdf", 5, 0) for k, x in enumerate("xyz")}
    gone, fresh, half = {}, {}, None
    for low, high in zip([0, *borders], [*borders, len(events)], strict=True):
        batch = live.Batch(docs.get, lambda start: [k for k in docs if k.startswith(start)], gone, fresh, 2000)
        batch.half = half
        batch.apply([dict(e) for e in events[low:high]])
        docs |= batch.docs
        docs = {k: v for k, v in docs.items() if v is not None}
        half = batch.half
    return docs


@pytest.mark.parametrize("seed", range(60))
def test_borders_of_batches_change_nothing(seed):
    draw = random.Random(seed)
    events = random_events(draw, 40)
    whole = run(events, [])
    for _ in range(5):
        assert run(events, sorted(draw.sample(range(1, 40), draw.randrange(1, 8)))) == whole
    assert len({d[0] for d in whole.values()}) == len(whole)


def test_identity():
    """One event list for each way in which a document keeps or loses its number."""
    event = lambda seq, ts, kind, path, to=None, size=5: {"seq": seq, "ts_ms": ts, "kind": kind, "path": path, "path_to": to, "size": size, "modified_at": 1, "is_doc": is_doc(path), "is_doc_to": is_doc(to)}
    ids = lambda *events: {k: d[0] for k, d in run(list(events), []).items() if d[0] not in (1, 2)}
    x = "/r/a/x.pdf"
    assert ids(event(1, 0, "rename_from", x), event(2, 9, "rename_to", "/r/q.pdf")) == {"/r/q.pdf": 0}
    assert ids(event(1, 0, "remove", x), event(2, 1999, "create", "/r/b/X.pdf")) == {"/r/b/x.pdf": 0}
    assert ids(event(1, 0, "remove", x), event(2, 2001, "create", "/r/b/x.pdf")) == {"/r/b/x.pdf": -3}
    assert ids(event(1, 0, "create", "/r/b/x.pdf"), event(2, 1, "remove", x)) == {"/r/b/x.pdf": 0}
    assert ids(event(1, 0, "create", "/r/b/x.pdf", size=6), event(2, 1, "remove", x)) == {"/r/b/x.pdf": -2}
    assert ids(event(1, 0, "create", "/r/a/t.tmp"), event(2, 1, "rename_both", x, "/r/a/o.tmp"), event(3, 2, "rename_both", "/r/a/t.tmp", x, 8), event(4, 3, "remove", "/r/a/o.tmp")) == {x: 0}
    assert ids(event(1, 0, "create", "/r/n.pdf"), event(2, 1, "remove", "/r/n.pdf")) == {x: 0}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    base = 1_700_000_000
    at = lambda second: F.timestamp_seconds(F.lit(base + second)).cast("timestamp")
    known = spark.createDataFrame([("R", 1, "/R/old/one.pdf", 5, 0), ("R", 2, "/R/two.pdf", 6, 0), ("S", 3, "/S/three.pdf", 7, 0)], "root string, id long, path string, size long, modified_at long")
    steps = [
        [("R", 1, 0, "rename_both", "/R/old", "/R/new"), ("S", 2, 0, "remove", "/S/three.pdf", None)],
        [("S", 3, 1, "create", "/S/deep/three.pdf", None), ("R", 4, 1, "remove", "/R/two.pdf", None)],
        [("R", 5, 20, "create", "/R/new/four.pdf", None), ("R", 6, 20, "modify", "/R/new/one.pdf", None)],
        [("R", 7, 60, "other", "", None), ("S", 8, 60, "other", "", None)],
        [("R", 9, 90, "other", "", None), ("S", 10, 90, "other", "", None)],
    ]

    def play(name, runs):
        """Each run appends some steps, then a query over all that is there begins and ends."""
        source, out = f"{tmp_path}/{name}/in", f"{tmp_path}/{name}/out"
        for group in runs:
            for k in group:
                rows = spark.createDataFrame([(r, q, t, kind, p, to, 7, 1) for r, q, t, kind, p, to in steps[k]], "root string, seq long, t long, kind string, path string, path_to string, size long, modified_at long")
                rows.withColumn("ts", F.timestamp_seconds(F.col("t") + base)).select("root", "seq", "ts", "kind", "path", "path_to", "size", "modified_at").coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            write = live.live_changes(stream, known, late="1 second").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True)
            write.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}")).start().awaitTermination()
        rows = live.settled(spark.read.schema(live.OUT + ", batch int").parquet(out)).collect()
        return {(r["id"], r["path"], r["size"], r["change"]) for r in rows}

    whole = play("whole", [range(5)])
    assert whole == {(1, "/R/new/one.pdf", 7, "updated"), (2, "/R/two.pdf", 6, "removed"), (3, "/S/deep/three.pdf", 7, "moved"), (-6, "/R/new/four.pdf", 7, "added")}
    assert play("parts", [[0], [1, 2], [3, 4]]) == whole


def test_an_event_looks_at_documents_of_its_name_and_size_alone(monkeypatch):
    looked = []
    real = live.Waiting.__getitem__
    monkeypatch.setattr(live.Waiting, "__getitem__", lambda self, key: (looked.append(key), real(self, key))[1])
    docs = {f"/r/a/{k}.pdf": (k, f"/r/a/{k}.pdf", 5, 0) for k in range(500)}
    event = lambda seq, kind, path: {"seq": seq, "ts_ms": seq, "kind": kind, "path": path, "path_to": None, "size": 5, "modified_at": 0, "is_doc": True, "is_doc_to": False}
    events = [event(k, "remove", f"/r/a/{k}.pdf") for k in range(500)] + [event(500 + k, "create", f"/r/b/{k}.pdf") for k in range(500)]
    batch = live.Batch(docs.get, lambda start: [], {}, {}, 2000)
    batch.apply(events)
    assert sorted(batch.out.values()) == [(k, f"/r/b/{k}.pdf", 5, 0, "moved", 500 + k) for k in range(500)] and not batch.gone and len(looked) < 5000


def test_a_state_is_called_once_for_a_bucket_not_for_each_document():
    class State(dict):
        calls = 0

        def counted(self, value=None):
            self.calls += 1
            return value

        containsKey = lambda self, k: self.counted(k in self)
        getValue = lambda self, k: self.counted(self[k])
        updateValue = lambda self, k, v: self.counted(self.__setitem__(k, v))
        removeKey = lambda self, k: self.counted(self.pop(k))
        iterator = lambda self: iter(self.items())

    state, want = State(), {f"/r/é{k}": [k, f"/r/É{k}", None, 5] for k in range(20000)}
    for rows in (want, {k: want[k] for k in list(want)[::2]}):
        docs = live.Buckets(state)
        for k in want:
            docs.put(k, rows[k]) if k in rows else docs.remove(k)
        docs.write()
        assert dict(live.Buckets(state).stored()) == rows and live.Buckets(state).get("/r/é4") == want["/r/é4"] and live.Buckets(state).get("/r/x") is None
    assert state.calls <= 3 * 2 * live.BUCKETS + 6
