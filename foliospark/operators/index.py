"""Token postings of texts and trigrams of names: the tables that searches equi-join with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, trigrams, words
from ..sources.work import SENT_IDS, small_batches, stored


def row_postings(texts: DataFrame) -> DataFrame:
    """id, token, tf, positions (from 0, rising) of each row of texts (id, body), without a shuffle."""
    rows = texts.select("id", words(folded(F.col("body"))).alias("tokens"))
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, codes, pos, tokens = encoded(b.column(1))
            if not len(codes):
                continue
            order = np.argsort(row * len(tokens) + codes, kind="stable")
            row, codes, pos = row[order], codes[order], pos[order]
            begins = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (codes[1:] != codes[:-1]))))
            ends = np.append(begins, len(codes))
            positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[begins])), tokens.take(pa.array(codes[begins])), pa.array(np.diff(ends)), positions], ["id", "token", "tf", "positions"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, token string, tf long, positions array<int>")


def encoded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of the strings in a batch's lists: row, code and place in the list (from 0), and the distinct strings that the codes stand for. Null lists are empty."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(n)), n)
    return row, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), flat.dictionary


def postings(texts: DataFrame) -> DataFrame:
    """id, token, tf, positions (from 0, rising) of texts (id, body). Made where a text is read; only rows of ids that occur several times are shuffled, as these are one document."""
    repeated = stored(texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("_id")), "repeated")
    if repeated.isEmpty():
        return row_postings(texts)
    same = F.col("id").eqNullSafe(F.col("_id"))
    each = texts.join(repeated, same, "left_semi").select("id", F.posexplode(words(folded(F.col("body")))).alias("pos", "token"))
    joined = each.groupBy("id", "token").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return row_postings(texts.join(repeated, same, "left_anti")).unionByName(joined)


def doc_stats(texts: DataFrame) -> DataFrame:
    """id, n_tokens."""
    return texts.select("id", F.size(words(folded(F.col("body")))).alias("n_tokens"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs and mean_tokens of all texts."""
    return stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("mean_tokens"))


def name_grams(catalog: DataFrame, text: Column) -> DataFrame:
    """gram, id: each document's distinct trigrams of text."""
    return catalog.select("id", F.explode(trigrams(text)).alias("gram"))


def short_grams(catalog: DataFrame, text: Column) -> DataFrame:
    """gram, id: each document's distinct runs of one and of two characters of text."""
    ends = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    both = F.concat(F.transform(ends, lambda i: F.substring(text, i, F.lit(1))), F.transform(ends, lambda i: F.substring(text, i, F.lit(2))))
    return catalog.select("id", F.explode(F.array_distinct(both)).alias("gram"))


def name_words(catalog: DataFrame) -> DataFrame:
    """word, id: each document's distinct words of its name, in lower case."""
    return catalog.select("id", F.explode(F.array_distinct(words(F.lower("name")))).alias("word"))


def refreshed(old: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after some documents' texts changed: theirs are replaced (or cleared, where body is null), the others are carried over. changed: id, body."""
    ids = stored(changed.select("id").distinct(), "changed-ids")
    kept = old.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", "left_anti")
    return kept.unionByName(postings(changed.filter("body IS NOT NULL")))


def set_texts(texts: DataFrame, changed: DataFrame) -> DataFrame:
    """id, body after changes; a null body clears a document's text."""
    return texts.join(changed.select("id").distinct(), "id", "left_anti").unionByName(changed.filter("body IS NOT NULL").select("id", "body"))
