"""I-Match fingerprints: distinct terms of a text within a band of document frequency, sorted, hashed over randomised subsets of the lexicon.

The lexicon holds the corpus's terms with document frequency, over distinct texts, from ``least`` to ``most`` of these (so inverse document frequency from
-ln(most) to -ln(least)). All texts have at most (number of texts) * (mean number of distinct terms) term places, so at most
(mean distinct terms) / least terms can be in the band, whatever the size of the corpus: that bound is what lets it be broadcast. It is counted first: beyond
``MOST_TERMS`` it is sent as sorted 64-bit hashes, 8 bytes a term. Each of the random
sublexicons keeps a term with its own probability, halving from one half down, so that texts of any length keep a few terms in some
of them. A sublexicon's signature is a 64-bit hash of the kept terms in sorted order, 0 if none; equal texts have equal signatures. A text of which no sublexicon keeps a term
gets signatures of all its own terms in sorted order (of the text itself if it has none). Likeness of two
fingerprints: equal signatures over those that aren't 0 in both; 1 if all are.

Edge cases: a null text counts as empty (all signatures 0); rows of one id, null ids among them, are ordered by a hash of their text; an empty table gives an empty table; other input columns aren't used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stored, text_of

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Sublexicons of each keeping probability 1/2, 1/4, ... 1/2**HALVINGS; terms of which a task remembers the sublexicons.
EACH, HALVINGS, REMEMBERED = 4, 9, 200_000
SIZE = EACH * HALVINGS
#: A signature is from 1 to this, or 0.
LARGEST = 2**64 - 1
#: Distinct terms that a task counts before it hands its sums on, and terms of the lexicon that are sent as they are.
HELD, MOST_TERMS = 500_000, 2_000_000


def terms(text: str) -> set[bytes]:
    return set(TERM.findall(text.encode("utf-8", "replace").lower()))


def document_frequency(docs: DataFrame, text_col: str = "text", contents: DataFrame | None = None) -> DataFrame:
    """term (binary) and df (distinct texts that hold it). contents: the stored ``contents_of`` docs.

    Each of n copies counts 1/n; these add up to whole numbers, which rounding restores.
    """
    contents = contents_of(docs, text_col) if contents is None else contents
    repeated = sized(stored(contents.filter("n > 1"), "repeated"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, float] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(count)
            for k in range(0, len(names), 100_000):
                part = names[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([count[t] for t in part], pa.float64())], ["term", "df"])
            count.clear()

        for b in batches:
            for t, n in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                share = 1.0 / n
                for term in terms(t.as_py()):
                    count[term] = count.get(term, 0.0) + share
                if len(count) > HELD:
                    yield from flush()
        yield from flush()

    rows = docs.select(text_of(text_col).alias("text")).join(repeated, _content("text") == F.col("content"), "left").select("text", F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    return rows.mapInArrow(run, "term binary, df double").groupBy("term").agg(F.round(F.sum("df")).cast("long").alias("df"))


def _content(text_col: str) -> Column:
    return F.unhex(F.md5(text_of(text_col).cast("binary")))


def contents_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """content (a hash) and n (rows) of each distinct text."""
    return stored(docs.select(_content(text_col).alias("content")).groupBy("content").agg(F.count("*").alias("n")), "contents")


def lexicon(docs: DataFrame, least: float = 0.001, most: float = 0.2, text_col: str = "text") -> DataFrame:
    """The terms in the band; its size is bounded as said above."""
    contents = contents_of(docs, text_col)
    n = contents.count()
    return stored(document_frequency(docs, text_col, contents).filter(F.col("df").between(least * n, most * n)).select("term"), "lexicon")


class Hashed:
    """A large lexicon as sorted hashes of its terms; ``&`` gives those of a set's terms that are in it."""

    def __init__(self, terms_: Iterator[bytes]):
        from xxhash import xxh64_intdigest

        self.hashes = np.sort(np.fromiter((xxh64_intdigest(t) for t in terms_), np.uint64))

    def __rand__(self, some: set[bytes]) -> set[bytes]:
        from xxhash import xxh64_intdigest

        own = list(some)
        hashes = np.fromiter((xxh64_intdigest(t) for t in own), np.uint64, len(own))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return {own[k] for k in np.flatnonzero(self.hashes[at] == hashes).tolist()}


def band_of(found: DataFrame) -> frozenset[bytes] | Hashed:
    """The lexicon (stored) for the driver to send."""
    each = (bytes(r[0]) for r in found.toLocalIterator())
    return frozenset(each) if found.count() <= MOST_TERMS else Hashed(each)


def signer(band: frozenset[bytes] | Hashed, seed: int) -> Callable[[str], tuple[int, ...]]:
    """Text to signatures."""
    from xxhash import xxh64_digest, xxh64_intdigest

    of: dict[bytes, list[int]] = {}

    def subsets(term: bytes) -> list[int]:
        draws = np.frombuffer(b"".join(xxh64_digest(term, seed + k) for k in range(-(-2 * SIZE // 8))), "<u2")[:SIZE]
        limits = np.repeat(65536 >> np.arange(1, HALVINGS + 1), EACH)
        return np.flatnonzero(draws < limits).tolist()

    def sign(text: str) -> tuple[int, ...]:
        kept: list[list[bytes]] = [[] for _ in range(SIZE)]
        every = terms(text)
        for t in sorted(every & band):
            own = of.get(t)
            if own is None:
                if len(of) > REMEMBERED:
                    of.clear()
                own = of[t] = subsets(t)
            for k in own:
                kept[k].append(t)
        if text and not any(kept):
            own_terms = b"\0" + (b" ".join(sorted(every)) or b"\0" + text.encode("utf-8", "replace"))
            return tuple([xxh64_intdigest(own_terms, seed + k) % LARGEST + 1 for k in range(SIZE)])
        return tuple([xxh64_intdigest(b" ".join(ts), seed) % LARGEST + 1 if ts else 0 for ts in kept])

    return sign


def likeness(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    some = sum(x or y for x, y in ((bool(x), bool(y)) for x, y in zip(a, b, strict=True)))
    return sum(x == y and x > 0 for x, y in zip(a, b, strict=True)) / some if some else 1.0


def shown(a: tuple[int, ...]) -> str:
    return "".join(f"{x:016x}" for x in a)


def fingerprints(docs: DataFrame, least: float = 0.001, most: float = 0.2, seed: int = 42, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and fingerprint (16 hexadecimal digits for each sublexicon) of each row."""
    spark = docs.sparkSession
    band = spark.sparkContext.broadcast(band_of(lexicon(docs, least, most, text_col)))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer(band.value, seed)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shown(sign(t.as_py())) for t in b.column(1)], pa.string())], [id_col, "fingerprint"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def compare_with_next(docs: DataFrame, least: float = 0.001, most: float = 0.2, seed: int = 42, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document by descending id (after the last: the first).

    Texts are sorted once, by ranges of ids; each task compares a row with the one after it. The last row of a range and the first of
    the following one (as many as there are ranges) are joined afterwards. Null ids come last; rows with one id in the order of a hash of their text.
    """
    spark = docs.sparkSession
    band = spark.sparkContext.broadcast(band_of(lexicon(docs, least, most, text_col)))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.desc_nulls_last("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(sign, text: str, own: tuple[int, ...], following: str, other: tuple[int, ...]) -> tuple:
        edited = edited_text(text, following)
        marks = sign(edited)
        return len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), shown(own), shown(marks), likeness(own, marks), likeness(own, other)

    def batch(ids: list, found: list[tuple], id_kind: pa.DataType, edges: list[tuple] | None) -> pa.RecordBatch:
        columns = [pa.array(ids, id_kind), *[pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]]
        if edges is None:
            return pa.RecordBatch.from_arrays(columns, list(FIELDS))
        kinds = [pa.string(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(c, t) for c, t in zip(zip(*edges, strict=True), kinds, strict=True)]], [*FIELDS, "edge", "range", "text"])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, part = signer(band.value, seed), TaskContext.get().partitionId()
        before = None
        for b in batches:
            ids, found, edges = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                own = sign(text)
                if before is None:
                    ids.append(i)
                    found.append((None,) * 6)
                    edges.append(("first", part, text))
                else:
                    ids.append(before[0])
                    found.append(compared(sign, before[1], before[2], text, own))
                    edges.append((None, None, None))
                before = (i, text, own)
            if ids:
                yield batch(ids, found, b.column(0).type, edges)
        if before is not None:
            yield batch([before[0]], [(None,) * 6], b.column(0).type, [("last", part, before[1])])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer(band.value, seed)
        for b in batches:
            pairs = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            found = [compared(sign, text, sign(text), following, sign(following)) for text, following in pairs]
            if found:
                yield batch(b.column(0).to_pylist(), found, b.column(0).type, None)

    table = stored(ordered.mapInArrow(along, f"{schema}, edge string, range int, text string"), "compared")
    firsts = table.filter("edge = 'first'").select("range", F.col("text").alias("following"))
    turn = Window.orderBy("range")  # one row per range
    ranges = firsts.select("range").withColumn("after", F.coalesce(F.lead("range").over(turn), F.min("range").over(Window.partitionBy())))
    lasts = table.filter("edge = 'last'").select("doc_id", "range", "text").join(ranges, "range").join(firsts.withColumnRenamed("range", "after"), "after")
    closing = lasts.select("doc_id", "text", "following").mapInArrow(across, schema)
    return table.filter("edge IS NULL").select(*FIELDS).unionByName(closing)
