"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = logistic(w . x - threshold_k): one weight for each word, shared by all thresholds, and rising thresholds. x has 1 + log(count)
for each word of the text and for each beginning of a word of 4 to 6 bytes (inflected forms share it), by 32-bit hashes. Labels tell toxic from clean only; grades are made from them: 0 is clean, and toxic
documents are divided into ``grades`` - 1 severities of like number by how much they hold of what is over-represented in toxic documents. The output is the
expected severity, the sum of P(grade >= k), the likeliest grade, and whether P(grade >= 1) is at least one half.

The model is fitted on at most ``sample`` labelled documents with at most ``sample_bytes`` of text, in the order of a hash of their ids, on all features that tell toxic from clean ones there
(in five documents or more, z score over ``least_z``), by proximal gradient steps with an L1 penalty, in numpy on the driver. The sample's bounds also bound the number of features,
so the model doesn't grow with the corpus. Scoring is one pass without a shuffle.

Edge cases: a null text counts as empty (no features); labels that are null or whose id is null are left out, an id labelled
twice counts once, with its largest label; without a toxic and a clean label nothing is toxic (severity 0); an empty table gives an empty
table; repeated rows are scored each; input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, fold, stored, text_of, unboxed
from .ri_quality import sampled

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
ADDED = ("severity", "grade", "p_toxic", "toxic")
REMEMBERED = 300_000


BEGINNINGS = (4, 5, 6)


class Hashes(dict):
    """A word's features: hashes of the word and of its beginnings (marked by a byte that no word holds)."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = [crc32(word), *(crc32(word[:n] + b"-") for n in BEGINNINGS if len(word) >= n)]
        return found


def hashed(text: str, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features' hashes and counts."""
    words = Counter(WORD.findall(text.encode("utf-8", "replace").lower()))
    each = [hashes[w] for w in words]
    flat, at = np.unique(np.fromiter(chain.from_iterable(each), np.uint32), return_inverse=True)
    return flat, np.bincount(at, np.repeat(np.array([*words.values()], float), [len(x) for x in each]), len(flat)).astype(np.uint32)


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, evidence: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one row per document."""
        return 1 / (1 + np.exp(-np.clip(evidence[:, None] - self.thresholds[None, :], -50, 50)))

    def evidence(self, words: np.ndarray, counts: np.ndarray) -> float:
        if not len(self.words) or not len(words):
            return 0.0
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return float(np.sum(np.where(self.words[at] == words, self.weights[at] * (1 + np.log(counts)), 0.0)))


def fit(words: np.ndarray, over: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grades: int = 4, l1: float = 1e-4, steps: int = 600) -> Model:
    """words: the chosen features, sorted; over: which of them toxic documents have more often; docs: the places of a document's features in words, and counts."""
    none = Model(np.zeros(0, np.uint32), np.zeros(0), np.full(grades - 1, 50.0))
    if not len(words) or toxic.all() or not toxic.any():
        return none
    row = np.repeat(np.arange(len(docs)), [len(w) for w, _ in docs])
    col = np.concatenate([w for w, _ in docs]).astype(np.int64)
    x = 1 + np.log(np.concatenate([c for _, c in docs]).astype(float))
    found = np.bincount(row[over[col]], x[over[col]], len(docs))
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(found[toxic], np.arange(1, grades - 1) / (grades - 1)), found, "right"), 0)
    size = np.sqrt(np.bincount(col, x * x, len(words)) / len(docs))  # columns are brought to one size, which makes the steps even
    size[size == 0] = 1
    x = x / size[col]
    reached = grade[:, None] >= np.arange(1, grades)[None, :]
    w, t = np.zeros(len(words)), np.log((1 - reached.mean(0) + 1e-6) / (reached.mean(0) + 1e-6))
    # Proximal gradient with momentum; the cumulative links are scored as one binary decision for each threshold. The step follows from the largest eigenvalue.
    v, largest = np.ones(len(words)), 0.0
    for _ in range(30):
        v = np.bincount(col, np.bincount(row, v[col] * x, len(docs))[row] * x, len(words))
        largest = float(np.linalg.norm(v))
        v /= largest or 1.0
    step = 1.0 / (0.25 * (grades - 1) * (largest / len(docs) + 1))
    ahead_w, ahead_t, momentum = w.copy(), t.copy(), 1.0
    for _ in range(steps):
        evidence = np.bincount(row, ahead_w[col] * x, len(docs))
        wrong = (1 / (1 + np.exp(-np.clip(evidence[:, None] - ahead_t[None, :], -50, 50))) - reached) / len(docs)
        new_w = ahead_w - step * np.bincount(col, wrong.sum(1)[row] * x, len(words))
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0)
        new_t = np.sort(ahead_t + step * wrong.sum(0))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead_w, ahead_t = new_w + (momentum - 1) / faster * (new_w - w), np.sort(new_t + (momentum - 1) / faster * (new_t - t))
        w, t, momentum = new_w, new_t, faster
    some = w != 0
    return Model(words[some], (w / size)[some], t)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = 20_000, folds: int = 5, held: int = 0, sample_bytes: int = 1 << 28, least_z: float = 4.0, text_col: str = "text", id_col: str = "doc_id", **how) -> Model:
    """From labelled documents, but those whose fold is held. The features are counted and chosen by Spark; the driver gets the chosen ones of the sample's documents."""
    ids = F.broadcast(sampled(labels, fold("doc_id", folds) == held, label_col, sample))  # at most sample rows
    every = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    sizes = every.select("doc_id", F.octet_length("text").alias("size")).join(ids, "doc_id").groupBy("doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), (F.max("label") > 0).alias("toxic"))
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most sample rows
    taken = stored(sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= sample_bytes).select("doc_id", "toxic", "rows"), "taken")
    rows = every.join(F.broadcast(taken.select("doc_id", "toxic")), "doc_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            each = [hashed(t.as_py(), hashes)[0] for t in b.column(1)]
            toxic = np.repeat(b.column(2).to_numpy(zero_copy_only=False), [len(w) for w in each])
            words, at = np.unique(np.concatenate([*each, np.zeros(0, np.uint32)]), return_inverse=True)
            of = np.bincount(at, toxic.astype(float), len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(np.bincount(at, minlength=len(words)) - of), pa.array(of)], ["word", "d0", "d1"])

    n0, n1 = (n or 0 for n in taken.agg(F.sum(F.when(~F.col("toxic"), F.col("rows"))), F.sum(F.when(F.col("toxic"), F.col("rows")))).first())
    share = (F.col("d0") + F.col("d1")) / (n0 + n1)
    z = (F.col("d1") / max(n1, 1) - F.col("d0") / max(n0, 1)) / F.sqrt(share * (1 - share) * (1 / max(n1, 1) + 1 / max(n0, 1)) + 1e-12)
    by = rows.mapInArrow(counted, "word long, d0 long, d1 long").groupBy("word").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1")).filter("d0 + d1 >= 5")
    chosen = by.select("word", z.alias("z")).filter(F.abs("z") >= least_z).collect()
    order = np.argsort([r["word"] for r in chosen]) if chosen else np.zeros(0, int)
    words, over = np.array([chosen[k]["word"] for k in order], np.uint32), np.array([chosen[k]["z"] > 0 for k in order], bool)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            at, counts = [], []
            for t in b.column(1):
                own, n = hashed(t.as_py(), hashes)
                some = np.isin(own, words)
                at.append(np.searchsorted(words, own[some]).astype(np.uint32).tobytes())
                counts.append(n[some].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "toxic", "at", "counts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    one = rows.mapInArrow(kept, f"doc_id {kind}, toxic boolean, at binary, counts binary").groupBy("doc_id").agg(F.min(F.struct("toxic", "at", "counts")).alias("x"))
    known = sorted(one.select("doc_id", "x.*").collect(), key=lambda r: r["doc_id"])
    return fit(words, over, [(np.frombuffer(r["at"], np.uint32), np.frombuffer(r["counts"], np.uint32)) for r in known], np.array([r["toxic"] for r in known], bool), **how)


def grade(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with severity (expected grade), grade (the likeliest), p_toxic (P(grade >= 1)), toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = Hashes()
        for texts in batches:
            yield pd.Series([sent.value.evidence(*hashed(t, hashes)) for t in texts], dtype="float64")

    rows = docs.select(boxed(docs, *ADDED).alias("doc"), evidence(text_of(text_col)).alias("evidence"))
    p = [1 / (1 + F.exp(F.lit(float(t)) - F.col("evidence"))) for t in model.thresholds]
    exactly = [1 - p[0], *[a - b for a, b in zip(p, p[1:], strict=False)], p[-1]]
    likeliest = F.array_position(F.array(*exactly), F.array_max(F.array(*exactly))) - 1
    return rows.select(*unboxed(docs, "doc", *ADDED), sum(p[1:], p[0]).alias("severity"), likeliest.cast("int").alias("grade"), p[0].alias("p_toxic"), (p[0] >= 0.5).alias("toxic"))
