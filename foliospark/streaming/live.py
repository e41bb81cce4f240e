"""The current state of a catalog, kept up by a stream of change events.

State is kept for each root, in a state store on disk (RocksDB): its documents by path, what vanished and what appeared of late, each in 1,024 buckets at most. Events of a micro-batch are applied in the order of their numbers. A document keeps its id through renames of itself
and of folders around it. One that vanished stays known for ``hold_ms`` of event time: if a document of the same name and size appears in that time, before or after, it has moved, and if its own path is written
again, it was saved. Only then is a removal or an arrival final and emitted, by a timer. All of this goes by the events' own times and numbers, so it doesn't matter where micro-batches end; two halves of a rename also
meet across a border.

Rows for a root are as many as a micro-batch has for it; a folder's event reads the root's paths once. A new document's id is -1 - seq of the event that brought it.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator, MutableMapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.formats import extension, is_enabled, is_lock_file

OUT = "root string, id long, path string, size long, modified_at long, change string, seq long"
#: Values that a root's documents are kept in.
BUCKETS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def is_document(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.coalesce(is_enabled(extension(name), opted_in=("txt", "md")) & ~is_lock_file(name), F.lit(False))


def _number(x: Any) -> int | None:
    return None if pd.isna(x) else int(x)


def _alike(doc: tuple) -> tuple:
    """What a document that moved keeps: its name (lower case) and size."""
    return doc[1].rpartition("/")[2].lower(), doc[2]


class Waiting(MutableMapping):
    """Of rows (by key, (document, seq, ts); kept up to date) also those of a name and size, and of a seq, so that an event looks at those alone."""

    def __init__(self, rows: dict):
        self.rows = rows
        self.alike: dict[tuple, set] = {}
        self.by_seq: dict[int, set] = {}
        for k, v in rows.items():
            self._add(k, v)

    def _add(self, key: str, value: tuple) -> None:
        self.alike.setdefault(_alike(value[0]), set()).add(key)
        self.by_seq.setdefault(value[1], set()).add(key)

    def __getitem__(self, key: str) -> tuple:
        return self.rows[key]

    def __setitem__(self, key: str, value: tuple) -> None:
        self.pop(key, None)
        self.rows[key] = value
        self._add(key, value)

    def __delitem__(self, key: str) -> None:
        doc, seq, _ = self.rows.pop(key)
        for index, of in ((self.alike, _alike(doc)), (self.by_seq, seq)):
            index[of].discard(key)
            if not index[of]:
                del index[of]

    def __iter__(self) -> Iterator[str]:
        return iter(self.rows)

    def __len__(self) -> int:
        return len(self.rows)


class Batch:
    """One micro-batch of a root: an overlay over its stored documents, and the rows to emit."""

    def __init__(self, find, below, gone: dict, fresh: dict, hold_ms: int):
        """find(key): a stored document or None; below(folder): the stored keys inside. gone, fresh: by key, (document, seq, ts) of what vanished and what appeared."""
        self.find, self.stored_below, self.gone, self.fresh, self.hold = find, below, Waiting(gone), Waiting(fresh), hold_ms
        self.docs: dict[str, tuple | None] = {}
        self.out: dict[int, tuple] = {}
        self.half: tuple[str, int] | None = None

    def get(self, key: str) -> tuple | None:
        if key not in self.docs:
            self.docs[key] = self.find(key)
        return self.docs[key]

    def below(self, folder: str) -> list[str]:
        start = folder.rstrip("/") + "/"
        keys = {k for k in self.stored_below(start)} | {k for k in self.docs if k.startswith(start)}
        return sorted(k for k in keys if self.get(k) is not None)

    def emit(self, doc: tuple, change: str, seq: int) -> None:
        self.out[doc[0]] = (*doc, change, seq)

    def _near(self, side: Waiting, doc: tuple, ts: int) -> str | None:
        return min((k for k in side.alike.get(_alike(doc), ()) if abs(ts - side[k][2]) <= self.hold), default=None)

    def write(self, path: str, size: int | None, modified_at: int | None, seq: int, ts: int) -> None:
        key, known = path.lower(), self.get(path.lower())
        if known is not None:
            self.docs[key] = doc = (known[0], path, size, modified_at)
            if key in self.fresh:
                self.fresh[key] = (doc, *self.fresh[key][1:])
            elif doc != known:
                self.emit(doc, "moved" if known[1] != path else "updated", seq)
            return
        doc = (-1 - seq, path, size, modified_at)
        back = key if key in self.gone and ts - self.gone[key][2] <= self.hold else self._near(self.gone, doc, ts)
        if back is not None:
            old = self.gone.pop(back)[0]
            self.docs[key] = doc = (old[0], path, size, modified_at)
            if doc != old:
                self.emit(doc, "moved" if path != old[1] else "updated", seq)
            return
        self.docs[key], self.fresh[key] = doc, (doc, seq, ts)

    def remove(self, key: str, seq: int, ts: int) -> None:
        doc = self.get(key)
        for k in [key] if doc is not None else self.below(key):
            doc, self.docs[k] = self.get(k), None
            if self.fresh.pop(k, None) is not None:
                continue  # came and went
            came = self._near(self.fresh, doc, ts)
            if came is None:
                self.gone[k] = (doc, seq, ts)
                continue
            new = self.fresh.pop(came)[0]
            self.docs[came] = moved = (doc[0], *new[1:])
            self.emit(moved, "moved", seq)

    def restore(self, of: int, ts: int) -> None:
        """What the event of that number took away is back, where nothing else has come since."""
        for k in [k for k in self.gone.by_seq.get(of, ()) if ts - self.gone[k][2] <= self.hold]:
            if self.get(k) is None:
                self.docs[k] = self.gone.pop(k)[0]

    def rename(self, source: str, target: str, is_doc: bool, size: int | None, modified_at: int | None, seq: int, ts: int) -> None:
        key = source.lower()
        known = self.get(key)
        moves = [(key, target)] if known is not None else [(k, target.rstrip("/") + self.get(k)[1][len(source.rstrip("/")) :]) for k in self.below(key)]
        if not moves:
            if is_doc:
                self.write(target, size, modified_at, seq, ts)
            return
        if known is not None and not is_doc:
            self.remove(key, seq, ts)
            return
        for old, path in moves:
            doc, to = self.get(old), path.lower()
            self.docs[old] = None
            if to != old and self.get(to) is not None:
                self.remove(to, seq, ts)  # it was replaced
            self.docs[to] = doc = (doc[0], path, *doc[2:])
            came = self.fresh.pop(old, None)
            if came is not None:
                self.fresh[to] = (doc, *came[1:])
            else:
                self.emit(doc, "moved", seq)

    def apply(self, events: list[dict]) -> None:
        for e in events:
            kind, seq, ts, path = e["kind"], int(e["seq"]), int(e["ts_ms"]), e["path"]
            size, at = _number(e["size"]), _number(e["modified_at"])
            if kind in ("create", "modify"):
                if e["is_doc"]:
                    self.write(path, size, at, seq, ts)
            elif kind == "remove":
                self.remove(path.lower(), seq, ts)
            elif kind == "rename_both":
                self.rename(path, e["path_to"], e["is_doc_to"], size, at, seq, ts)
            elif kind == "rename_from":  # as if removed, until its other half comes
                self.remove(path.lower(), seq, ts)
                self.half = (path, seq)
            elif kind == "rename_to":
                if self.half is not None:
                    self.restore(self.half[1], ts)
                    self.rename(self.half[0], path, e["is_doc"], size, at, seq, ts)
                    self.half = None
                elif e["is_doc"]:
                    self.write(path, size, at, seq, ts)


class Buckets:
    """Rows (lists) by key in a state of BUCKETS values at most, as JSON: each call of the state is a message to its server, so a micro-batch reads and writes a bucket once, not each row."""

    def __init__(self, state):
        self.state, self.read, self.changed = state, {}, set()

    def _of(self, key: str) -> tuple[int, dict]:
        n = zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS
        if n not in self.read:
            self.read[n] = json.loads(self.state.getValue((n,))[0]) if self.state.containsKey((n,)) else {}
        return n, self.read[n]

    def get(self, key: str) -> list | None:
        return self._of(key)[1].get(key)

    def put(self, key: str, row: tuple) -> None:
        n, rows = self._of(key)
        rows[key] = list(row)
        self.changed.add(n)

    def remove(self, key: str) -> None:
        n, rows = self._of(key)
        if rows.pop(key, None) is not None:
            self.changed.add(n)

    def stored(self) -> Iterator[tuple[str, list]]:
        """All rows as they are in the state, one bucket after another."""
        for _, value in self.state.iterator():
            yield from json.loads(value[0]).items()

    def write(self) -> None:
        for n in self.changed:
            if self.read[n]:
                self.state.updateValue((n,), (json.dumps(self.read[n]),))
            elif self.state.containsKey((n,)):
                self.state.removeKey((n,))
        self.changed = set()


class LiveCatalog(StatefulProcessor):
    def __init__(self, hold_ms: int):
        self.hold = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.docs = handle.getMapState("docs", "bucket int", "rows string")  # id, path, size, modified_at
        self.gone = handle.getMapState("gone", "bucket int", "rows string")  # and seq, ts
        self.fresh = handle.getMapState("fresh", "bucket int", "rows string")
        self.half = handle.getValueState("half", "path string, seq long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        docs = Buckets(self.docs)
        for r in initialState.itertuples(index=False):
            docs.put(r.path.lower(), (int(r.id), r.path, _number(r.size), _number(r.modified_at)))
        docs.write()

    @staticmethod
    def _read(state) -> dict:
        return {k: (tuple(v[:4]), v[4], v[5]) for k, v in Buckets(state).stored()}

    @staticmethod
    def _write(state, before: dict, after: dict) -> None:
        rows = Buckets(state)
        for k in before.keys() - after.keys():
            rows.remove(k)
        for k, (doc, seq, ts) in after.items():
            if before.get(k) != (doc, seq, ts):
                rows.put(k, (*doc, seq, ts))
        rows.write()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq").to_dict("records")
        gone, fresh = self._read(self.gone), self._read(self.fresh)
        all_keys: list[str] = []

        docs = Buckets(self.docs)

        def find(k: str) -> tuple | None:
            doc = docs.get(k)
            return None if doc is None else tuple(doc)

        def below(start: str) -> list[str]:
            if not all_keys:  # once for each micro-batch that has a folder's event
                all_keys.extend(sorted(k for k, _ in docs.stored()))
            return all_keys[bisect_left(all_keys, start) : bisect_left(all_keys, start[:-1] + chr(ord("/") + 1))]

        batch = Batch(find, below, dict(gone), dict(fresh), self.hold)
        batch.half = tuple(self.half.get()) if self.half.exists() else None
        batch.apply(events)
        for k, doc in batch.docs.items():
            if doc is not None:
                docs.put(k, doc)
            else:
                docs.remove(k)
        docs.write()
        self._write(self.gone, gone, batch.gone)
        self._write(self.fresh, fresh, batch.fresh)
        if batch.half is not None:
            self.half.update(batch.half)
        else:
            self.half.clear()
        for ts in {x[2] for side in (batch.gone, batch.fresh) for x in side.values()}:
            self.handle.registerTimer(ts + self.hold + 1)
        yield self._frame(key, batch.out.values())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for state, change in ((self.gone, "removed"), (self.fresh, "added")):
            before = self._read(state)
            after = {k: v for k, v in before.items() if v[2] + self.hold >= now}
            out += [(*doc, change, seq) for k, (doc, seq, _) in before.items() if k not in after]
            self._write(state, before, after)
        yield self._frame(key, out)

    @staticmethod
    def _frame(key: tuple, rows) -> pd.DataFrame:
        kinds = {"root": "object", "id": "Int64", "path": "object", "size": "Int64", "modified_at": "Int64", "change": "object", "seq": "Int64"}
        return pd.DataFrame([(key[0], *r) for r in rows], columns=list(kinds)).astype(kinds)

    def close(self) -> None:
        pass


def live_changes(events: DataFrame, catalog: DataFrame, hold_ms: int = 2000, late: str = "0 seconds") -> DataFrame:
    """A stream of OUT rows: what became of documents, with the number of the event that did it. For each id the row of the largest seq counts, and of equal ones a removal or an arrival comes last.

    events: a stream of root, seq, ts, kind, path, path_to, size, modified_at, in scope, whose numbers rise with their times; catalog: root, id, path, size, modified_at when the stream begins. A rename between two roots comes as a removal and
    a write. The session keeps state in RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.withWatermark("ts", late).select(
        "root", "seq", "ts", F.unix_millis("ts").alias("ts_ms"), "kind", "path", "path_to", "size", "modified_at", is_document(F.col("path")).alias("is_doc"), is_document(F.col("path_to")).alias("is_doc_to"),
    )
    known = catalog.select("root", "id", "path", "size", "modified_at").groupBy("root")
    return rows.groupBy("root").transformWithStateInPandas(LiveCatalog(hold_ms), OUT, "Update", "EventTime", initialState=known)


def settled(changes: DataFrame) -> DataFrame:
    """For each id its last row of live_changes()."""
    last = F.col("change").isin("removed", "added")
    return changes.groupBy("root", "id").agg(F.max_by(F.struct("path", "size", "modified_at", "change", "seq"), F.struct("seq", last.alias("last"))).alias("x")).select("root", "id", "x.*")
