"""Ranked lexical search for a table of items, by a dual-tree search.

A document is a sparse vector: for each of its terms that an item has, the saturated frequency. An item has its terms' weights in the same coordinates, so that a score is an inner product of
two vectors without negative parts. There is a hierarchy over the items and one over each batch of documents, and each node of either holds the maxima of its members' coordinates. The product of
two nodes' maxima bounds all scores between them: a pair of nodes whose bound is below the weakest kth score of the node's items is dropped with everything below it. What is left
is scored exactly, in whole numbers. Documents are sorted by their two heaviest coordinates first, over ranges of the whole table, so a batch holds like ones.

The kth scores are known early: the table is searched in three levels, one row in 256, fifteen in 256 and the rest, each row in one level; what the levels before found are the
lower bounds of the next. No row is left out and none is searched twice.

Items are searched for in blocks of ``PAIRS`` pairs of item and term, about, so what a task is sent (a block's terms and trees) has one size; each block is a pass over the documents.

Edge cases: null and empty texts have no terms and are found by nothing, and such items find nothing; rows of one item id are one item with the terms of all its texts; repeated documents are
ranked each for itself; equal scores are ranked by id, null ids last; very long texts are counted whole; with an empty table on either side the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored, text_of

#: Pairs of item and term in a block of items, about; numbers in a batch's matrix; documents in a leaf; children of a node.
PAIRS, CELLS, LEAF, FAN = 1 << 15, 1 << 23, 32, 4
#: Of 256 rows, those of the first level and of the first two.
LEVELS = (1, 16)
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of any other letter or sign beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_TABLE).split()


def item_terms(items: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """item_id and its distinct terms, as binary."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in b.column(1)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([t for x in found for t in x], pa.binary())], ["item_id", "term"])

    return rows.mapInArrow(run, T.StructType([T.StructField("item_id", rows.schema["item_id"].dataType), T.StructField("term", T.BinaryType())])).distinct()


def vectors(docs: DataFrame, terms: list[bytes], text_col: str, id_col: str) -> DataFrame:
    """doc_id, n (all terms with repeats), ids and tfs (of the given terms) for each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(terms)}
        for b in batches:
            n, ids, tfs = [], [], []
            for t in b.column(1):
                words = terms_of(t.as_py())
                own = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                n.append(len(words))
                ids.append([k for k, _ in own])
                tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("n", "long").add("ids", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.LongType())))


def statistics(vecs: DataFrame, n_terms: int) -> tuple[int, int, list[int]]:
    """N, L and each term's document frequency. A task sends one row for each term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            n = b.column(0).to_numpy()
            df += np.bincount(b.column(1).flatten().to_numpy(), minlength=n_terms)
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int32()), pa.array([docs, length, *df[some].tolist()], pa.int64())], ["what", "n"])

    found = dict(vecs.select("n", "ids").mapInArrow(run, "what int, n long").groupBy("what").agg(F.sum("n")).collect())  # a block's terms
    return found.get(-2, 0), found.get(-1, 0), [found.get(k, 0) for k in range(n_terms)]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Node:
    """Of the hierarchy over items: the coordinates that any member has, and the members, in order."""

    terms: np.ndarray
    first: int
    last: int
    children: list[Node]


def item_tree(sets: list[np.ndarray], first: int = 0) -> Node:
    """Items are in an order that keeps like ones together; a node's members are cut into FAN runs."""
    node = Node(np.unique(np.concatenate(sets)), first, first + len(sets), [])
    if len(sets) > 1:
        cuts = np.unique(np.linspace(0, len(sets), FAN + 1).astype(int))
        node.children = [item_tree(sets[a:b], first + int(a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return node


def placed(vecs: DataFrame, weights: list[int], n_docs: int, length: int) -> DataFrame:
    """doc_id, level, ids, s (saturated frequencies) of documents with a term of an item, in ranges and sorted by level and heaviest coordinates."""
    w = np.array(weights, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, tf = b.column(1).to_numpy(), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            sizes = np.diff(b.column(2).offsets.to_numpy())
            m = 50 + 50 * n * n_docs // length
            s = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes))
            row = np.repeat(np.arange(len(b)), sizes)
            order = np.lexsort((ids, -w[ids] * s, row))
            start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            some = sizes > 0
            top = [np.zeros(len(b), np.int32) for _ in range(2)]
            top[0][some] = ids[order[start[some]]]
            top[1][some] = ids[order[start[some] + (sizes[some] > 1)]]
            out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(s.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), out, *map(pa.array, top)], ["doc_id", "ids", "s", "top", "next"]).filter(pa.array(some))

    schema = T.StructType([vecs.schema["doc_id"], vecs.schema["ids"]]).add("s", T.ArrayType(T.IntegerType())).add("top", "integer").add("next", "integer")
    share = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(256))
    level = F.when(share < LEVELS[0], 0).when(share < LEVELS[1], 1).otherwise(2)
    rows = vecs.filter(F.size("ids") > 0).select("doc_id", "n", "ids", "tfs").mapInArrow(run, schema).withColumn("level", level)
    spread = F.xxhash64("doc_id").alias("spread")  # many documents may have the same two
    return rows.select("*", spread).repartitionByRange("level", "top", "next", "spread").sortWithinPartitions("level", "top", "next").drop("top", "next", "spread")


class Best:
    """The k best documents of each item so far, from a floor on."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.kth, self.rows = k, floors.copy(), [[] for _ in floors]

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        """Scores and ids that belong together."""
        if len(scores) > self.k:
            least = np.partition(scores, -self.k)[-self.k]
            some = np.flatnonzero(scores >= least)
            scores, ids = scores[some], [ids[k] for k in some]
        rows = self.rows[item]
        rows += [(-s, i is None, i or 0, i) for s, i in zip(scores.tolist(), ids, strict=True)]
        rows.sort(key=lambda r: r[:3])
        del rows[self.k :]
        if len(rows) == self.k:
            self.kth[item] = max(self.kth[item], -rows[-1][0])


def search_batch(root: Node, w: np.ndarray, s: np.ndarray, ids: pa.Array, best: Best) -> int:
    """One batch of documents (s: terms by documents) against the items' tree. Returns how many pairs of item and document were scored exactly."""
    n = s.shape[1]
    leaves = -(-n // LEAF)
    padded = np.zeros((len(s), leaves * LEAF), np.float32)
    padded[:, :n] = s
    maxima = [padded.reshape(len(s), leaves, LEAF).max(2)]  # of each node's coordinates, leaves last
    while maxima[0].shape[1] > 1:
        below = maxima[0]
        maxima.insert(0, np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))
    scored = 0
    stack = [(root, 0, np.zeros(1, np.int64))]
    while stack:
        node, level, of = stack.pop()
        own = node.terms
        bound = w[own] @ maxima[level][np.ix_(own, of)].astype(np.float64)
        of = of[bound >= best.kth[node.first : node.last].min()]
        if not len(of):
            continue
        if level + 1 < len(maxima):
            deeper = (of[:, None] * FAN + np.arange(FAN)).ravel()
            deeper = deeper[deeper < maxima[level + 1].shape[1]]
            stack += [(c, level + 1, deeper) for c in node.children or [node]]
        elif node.children:
            stack += [(c, level, of) for c in node.children]
        else:
            at = (of[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < n]
            scores = (w[own] @ padded[np.ix_(own, at)].astype(np.float64)).astype(np.int64)  # whole numbers below 2^53: exact
            scored += len(at)
            hit = np.flatnonzero(scores >= best.kth[node.first])
            if len(hit):
                best.add(node.first, scores[hit], ids.take(pa.array(at[hit])).to_pylist())
    return scored


def searched(rows: DataFrame, sets: list[np.ndarray], weights: list[int], floors: np.ndarray, k: int) -> DataFrame:
    """item_id, doc_id, score: of each partition of rows (of placed()) the k best documents of each item, from the floors on."""
    w, size = np.array(weights, np.float64), len(weights)
    schema = T.StructType([T.StructField("item", T.IntegerType()), rows.schema["doc_id"]]).add("score", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, best = item_tree(sets), Best(floors, k)
        step = int(max(LEAF, min(2048, CELLS // max(size, 1))))
        kind = pa.int64()
        for whole in batches:
            kind = whole.column(0).type
            for low in range(0, len(whole), step):
                b = whole.slice(low, step)
                sizes = np.diff(b.column(1).offsets.to_numpy())
                s = np.zeros((size, len(b)), np.float32)
                s[b.column(1).flatten().to_numpy(), np.repeat(np.arange(len(b)), sizes)] = b.column(2).flatten().to_numpy()
                search_batch(root, w, s, b.column(0), best)
        item = np.repeat(np.arange(len(best.rows)), [len(r) for r in best.rows])
        flat = [r for rs in best.rows for r in rs]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([r[3] for r in flat], kind), pa.array([-r[0] for r in flat], pa.int64())], ["item", "doc_id", "score"])

    return rows.select("doc_id", "ids", "s").mapInArrow(run, schema)


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, pairs: DataFrame, k: int, text_col: str, id_col: str) -> DataFrame:
    """item_id, rank, doc_id, score for the items of one block of pairs (item_id, term)."""
    spark = docs.sparkSession
    by_item: dict = {}
    for item, term in pairs.collect():  # a block's, of bounded size
        by_item.setdefault(item, []).append(bytes(term))
    if not by_item:
        return spark.createDataFrame([], T.StructType([pairs.schema["item_id"]]).add("rank", "integer").add("doc_id", docs.schema[id_col].dataType).add("score", "long"))
    terms = sorted({t for ts in by_item.values() for t in ts})
    number = {t: j for j, t in enumerate(terms)}
    vecs = stored(vectors(docs, terms, text_col, id_col), "vectors")
    n_docs, length, df = statistics(vecs, len(terms))
    weights = [weight(n_docs, x) for x in df]
    # Like items side by side: by their commonest terms, commonest first.
    each = sorted((sorted((-df[number[t]], number[t]) for t in ts), item is None, str(item), item) for item, ts in by_item.items())
    ids = spark.createDataFrame([(j, e[3]) for j, e in enumerate(each)], T.StructType([T.StructField("item", T.IntegerType()), pairs.schema["item_id"]]))
    sets = [np.sort(np.array([t for _, t in e[0]], np.int64)) for e in each]
    rows = stored(placed(vecs, weights, n_docs, max(length, 1)), "placed")
    discard(vecs)
    floors, found = np.ones(len(sets)), None
    for level in range(len(LEVELS) + 1):
        new = searched(rows.filter(F.col("level") == level), sets, weights, floors, k)
        new = stored(top(new if found is None else found.unionByName(new), k).drop("rank"), "found")
        if level < len(LEVELS):
            for j, n, least in new.groupBy("item").agg(F.count("*"), F.min("score")).collect():  # one row for each item of the block
                floors[j] = max(1, least if n >= k else 1)
        found = new
    return top(found, k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = 50, item_text: str = "text", item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    pairs = stored(item_terms(items, item_text, item_col), "item-terms")
    blocks = max(1, -(-pairs.count() // PAIRS))
    out = None
    for j in range(blocks):
        own = _block(docs, pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == j), k, text_col, id_col)
        out = own if out is None else out.unionByName(own)
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
