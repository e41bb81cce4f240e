"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every token slot (a token's hash into ``SLOTS``) has a sparse random index vector with a few +1 and -1. A slot's word vector is the sum of the index
vectors of its neighbours within two tokens, over all documents. Tokens are runs of letters and runs of other characters, so glyph junk
has vectors of its own. Tasks add up tables of fixed size (SLOTS x DIM numbers), cut into slices that are summed in
two shuffles (first over salted keys, so no task gets more than a share of the partial sums). The table, whose size
doesn't depend on the corpus, is normalised and broadcast. A document is the mean and the standard deviation of its tokens' vectors, and the
network (numpy, one hidden layer) is fitted on at most ``sample`` labelled documents, chosen by a hash of their ids. A
temperature fitted on a part of them that training doesn't see turns logits into probabilities.

Edge cases: a null text counts as empty, whose features are zero, and gets a score like others; labels that are null or whose id is null are left out,
an id labelled more than once counts once, with its largest label, and of texts with one id that of the smallest features is learnt from; without any usable label all scores are 0.5; an empty table gives an empty table; repeated rows are scored
each; input columns besides id and text aren't used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

TOKEN = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\x20\x09-\x0D]+")
SLOTS, DIM, NONZERO, WINDOW = 1 << 15, 64, 2, 2
SLICES, SALTS = 128, 16
#: Tokens that are handled at once, and tokens whose slots a task remembers.
STEP, REMEMBERED = 1 << 20, 300_000


class Slots(dict):
    """Token to slot, remembered; a full memory is emptied."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        slot = self[token] = crc32(token) % SLOTS
        return slot


def tokens(text: str) -> list[bytes]:
    return TOKEN.findall(text.encode("utf-8", "replace").lower())


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slot the places and signs of its index vector; slot SLOTS (between documents) has signs 0."""
    draw = np.random.default_rng(seed)
    place, sign = draw.integers(0, DIM, (SLOTS + 1, NONZERO)), draw.choice([-1.0, 1.0], (SLOTS + 1, NONZERO))
    sign[SLOTS] = 0
    return place, sign


def batches_of(column, slots: Slots) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts by the lump: slots of all tokens, and the number of tokens of each text."""
    ids, sizes = [], []
    for t in column:
        own = list(map(slots.__getitem__, tokens(t.as_py())))
        ids += own
        sizes.append(len(own))
        if len(ids) > STEP:
            yield np.array(ids, np.int64), np.array(sizes)
            ids, sizes = [], []
    if sizes:
        yield np.array(ids, np.int64), np.array(sizes)


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the slices by key; each task streams its rows and holds its keys' sums alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, part in zip(*(b.column(c).to_pylist() for c in (*keys, "part")), strict=True):
                new = np.frombuffer(part, np.float64 if len(part) == 8 * SLOTS * DIM // SLICES else np.float32)
                sums[tuple(key)] = sums[tuple(key)] + new if tuple(key) in sums else new.astype(np.float64)
        for key, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "part"])

    return parts.repartition(*keys).mapInArrow(run, "slice int, part binary")


def word_vectors(docs: DataFrame, seed: int = 42, text_col: str = "text") -> np.ndarray:
    """SLOTS x DIM, each row of length 1 (or 0 where nothing fell into the slot), from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(seed)
        slots, table = Slots(), np.zeros(SLOTS * DIM)
        for b in batches:
            for ids, sizes in batches_of(b.column(0), slots):
                starts = np.cumsum(sizes + WINDOW) - sizes - WINDOW
                line = np.full(len(ids) + WINDOW * len(sizes), SLOTS)
                line[np.repeat(starts, sizes) + np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = ids
                for k in range(1, WINDOW + 1):
                    for centre, near in ((line[:-k], line[k:]), (line[k:], line[:-k])):
                        real = centre < SLOTS
                        for j in range(NONZERO):
                            table += np.bincount(centre[real] * DIM + place[near[real], j], sign[near[real], j], SLOTS * DIM)
        part = TaskContext.get().partitionId()
        for k, piece in enumerate(table.astype(np.float32).reshape(SLICES, -1)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part % SALTS], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["slice", "salt", "part"])

    parts = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "slice int, salt int, part binary")
    table = np.zeros((SLICES, SLOTS * DIM // SLICES))
    for r in _summed(_summed(parts, ["slice", "salt"]), ["slice"]).collect():
        table[r["slice"]] = np.frombuffer(r["part"])
    table = table.reshape(SLOTS, DIM)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(size, size, 1)).astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and its features: 2 * DIM 32-bit numbers as binary."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slots = sent.value, Slots()
        for b in batches:
            out = []
            for ids, sizes in batches_of(b.column(1), slots):
                both = np.zeros((len(sizes), 2 * DIM), np.float32)
                some, starts = sizes > 0, np.cumsum(sizes) - sizes
                for of in np.array_split(np.flatnonzero(some), max(1, len(ids) >> 16)):
                    if len(of):
                        own = table[ids[starts[of[0]] : starts[of[-1]] + sizes[of[-1]]]]
                        at, n = starts[of] - starts[of[0]], sizes[of][:, None]
                        mean = np.add.reduceat(own, at) / n
                        both[of] = np.hstack([mean, np.sqrt(np.maximum(np.add.reduceat(own * own, at) / n - mean * mean, 0))])
                out += [x.tobytes() for x in both]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "features"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, features binary")


class Network(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-4, seed: int = 42) -> Network:
    """Adam on the cross entropy; the last sixth of a random order is kept back for the temperature."""
    draw = np.random.default_rng(seed)
    if not len(x):
        return Network(np.zeros(2 * DIM), np.ones(2 * DIM), np.zeros((2 * DIM, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    order = draw.permutation(len(x))
    train, kept = order[: len(x) - len(x) // 6], order[len(x) - len(x) // 6 :]
    centre, scale = x[train].mean(0), x[train].std(0) + 1e-6
    p = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    z = (x - centre) / scale
    for _ in range(epochs):
        mixed = draw.permutation(train)
        for k in range(0, len(mixed), 128):
            of = mixed[k : k + 128]
            h = np.tanh(z[of] @ p[0] + p[1])
            wrong = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y[of]) / len(of)
            back = wrong[:, None] * p[2] * (1 - h * h)
            step += 1
            for i, g in enumerate((z[of].T @ back + decay * p[0], back.sum(0), h.T @ wrong + decay * p[2], wrong.sum(keepdims=True))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    raw = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if not len(kept):
        return raw
    logit, sign = raw.logits(x[kept]), 2 * y[kept] - 1
    grid = np.exp(np.linspace(-2, 3, 101))
    return raw._replace(temperature=float(grid[int(np.argmin([np.logaddexp(0, -sign * logit / t).mean() for t in grid]))]))


def sampled(labels: DataFrame, held_out: Column, label_col: str, sample: int, id_col: str = "doc_id") -> DataFrame:
    """At most sample labelled ids that aren't held out: id and label."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out)
    return usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "quality", sample: int = 20_000, threshold: float = 0.3, seed: int = 42, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted for each row. held_out: of the column doc_id; such rows' labels aren't learnt from."""
    found = stored(features(docs, word_vectors(docs, seed, text_col), text_col, id_col), "features")
    known = found.join(sampled(labels, held_out, label_col, sample), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.max("label").alias("label"))
    rows = sorted(known.collect(), key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["features"], np.float32) for r in rows]).reshape(-1, 2 * DIM)
    network = fit(x, np.array([float(r["label"] > 0) for r in rows]), seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, 2 * DIM)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.probability(x).astype(np.float64))], ["doc_id", "score"])

    scored = found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
