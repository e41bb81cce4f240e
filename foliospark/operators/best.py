"""The best documents of frequent prefixes without scoring all of their hits: lists in blocks of like frequency and like length, with the largest frequency and the least length of each.

A document's score is at most what its block gives for one term and the best block among documents of its length for the others. A first pass scores the documents of each query's most promising blocks;
the score of the last one wanted is a bound, and only the blocks that may reach it are read for the result, which is that of search.content_hits, exactly. A list has a few thousand blocks at most, however
many documents there are. Prefixes of two and three characters have lists of their own (a document's frequencies summed), and longer ones that a single word has use the word's; others are summed when asked.
Queries with a phrase or a token of one character take the plain way.

Edge cases: null and empty texts have no tokens and are in no list; a prefix that no document holds gives its query no hit; ties go to the smaller id; without texts or queries there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, let, words
from ..sources.work import few, stored
from .index import corpus_stats
from .search import HEAD, K1, MAX_CONTENT, B, content_hits

WORD, BEGUN, SUMMED = 0, 1, 2
#: Levels of a query's bounds, and how many times the wanted number of documents the first pass should meet.
LEVELS, FIRST = 128, 3


def _with_blocks(rows: DataFrame) -> DataFrame:
    """rows with len_class (lengths within a twelfth) and tf_class (each frequency to 8, then within a fifth)."""
    tf = F.when(F.col("tf") <= 8, F.col("tf")).otherwise(8 + F.floor(F.log2(F.col("tf") / 8) * 4))
    return rows.withColumns({"len_class": F.floor(F.log2("n_tokens") * 8).cast("int"), "tf_class": tf.cast("int")})


def prefixes_of(queries: DataFrame) -> DataFrame:
    """prefix: the distinct first tokens of the queries' terms."""
    return queries.select(F.explode(F.transform("terms", lambda t: F.get(words(folded(t)), 0))).alias("prefix")).filter("prefix IS NOT NULL").distinct()


def lists(texts: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """kind, key, id, n_tokens, tf, len_class, tf_class of texts (id, body): a row for each document and token, and for each document and the first two or three characters of its tokens.

    One shuffle counts (after a count where a document is read), one puts the rows in order, so that blocks skip files and row groups once stored. prefixes (prefix, each once): only the lists that these need, for
    a table of queries that is known beforehand.
    """
    counted = lambda tokens: F.transform(tokens, lambda w: F.struct(F.size(tokens).alias("n_tokens"), w.alias("token")))
    rows = texts.select("id", F.explode(let(words(folded(F.col("body"))), counted)).alias("x")).select("id", "x.*")
    keys = [F.struct(F.lit(WORD).alias("kind"), F.col("token").alias("key"))] + [F.when(F.length("token") >= k, F.struct(F.lit(BEGUN).alias("kind"), F.substring("token", 1, k).alias("key"))) for k in range(2, HEAD + 1)]
    each = rows.select("id", "n_tokens", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k")).select("k.*", "id", "n_tokens")
    if prefixes is not None:
        begun = F.length("prefix") <= HEAD
        wanted = prefixes.select(F.when(begun, BEGUN).otherwise(WORD).alias("kind"), F.substring("prefix", 1, HEAD + 1).alias("head")).distinct()
        each = each.withColumn("head", F.substring("key", 1, HEAD + 1)).join(few(wanted, "wanted-lists")[0], ["kind", "head"], "left_semi").drop("head")
    order = ["kind", "key", "len_class", "tf_class", "id"]
    return _with_blocks(each.groupBy("kind", "key", "id", "n_tokens").agg(F.count("*").alias("tf"))).repartitionByRange(*order).sortWithinPartitions(*order)


def maxima(entries: DataFrame) -> DataFrame:
    """kind, key, len_class, tf_class, n, most_tf, least_len of lists: what bounds the scores of a block's documents, whatever the corpus' figures become."""
    return entries.groupBy("kind", "key", "len_class", "tf_class").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("n_tokens").alias("least_len"))


def prefix_counts(texts: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """prefix, df: the documents that hold a token with the prefix, of two characters or more. prefixes (prefix, each once): only of these."""
    if prefixes is not None:
        asked = few(prefixes.filter(F.length("prefix") >= 2), "asked-prefixes")[0]
        lengths = [r[0] for r in asked.select(F.length("prefix")).distinct().collect()]  # as many as there are lengths of a query's words
        first = lambda k: F.transform(F.filter("tokens", lambda w: F.length(w) >= k), lambda w: F.substring(w, 1, k))
        begun = F.flatten(F.array(*map(first, lengths))) if lengths else F.array().cast("array<string>")
        rows = texts.select(words(folded(F.col("body"))).alias("tokens")).select(F.explode(F.array_distinct(begun)).alias("prefix"))
        return rows.join(asked, "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("df"))
    tokens = F.filter(F.array_distinct(words(folded(F.col("body")))), lambda w: F.length(w) >= 2)
    begun = F.transform(tokens, lambda w: F.transform(F.sequence(F.lit(2), F.length(w)), lambda k: F.substring(w, F.lit(1), k)))
    return texts.select(F.explode(F.array_distinct(F.flatten(begun))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("df"))


def _part(tf: Column, length: Column) -> Column:
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("mean_tokens")))


def _asked(queries: DataFrame, counts: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, wanted, term, prefix, df, n_docs, mean_tokens, idf of each term that a document holds."""
    tokens = F.transform("terms", lambda t: F.get(words(folded(t)), 0))
    each = queries.select("query_id", F.size("terms").alias("wanted"), F.posexplode(tokens).alias("term", "prefix"))
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return each.join(counts, "prefix").crossJoin(F.broadcast(corpus_stats(stats))).withColumn("idf", idf)  # one row


def _found_lists(asked: DataFrame, entries: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """asked with kind and key of each term's list, and entries and blocks with the lists of prefixes that several words have."""
    wanted = asked.select("prefix").distinct()
    vocabulary = blocks.filter(F.col("kind") == WORD).select("key").distinct().withColumn("head", F.substring("key", 1, HEAD + 1))
    longer = wanted.filter(F.length("prefix") > HEAD).withColumn("head", F.substring("prefix", 1, HEAD + 1)).join(vocabulary, "head").filter(F.startswith("key", F.col("prefix"))).select("prefix", "key")
    longer = stored(longer, "prefix-words")
    counted = longer.groupBy("prefix").agg(F.count("*").alias("n"), F.min("key").alias("only"))
    many = longer.join(counted.filter("n > 1").select("prefix"), "prefix", "left_semi").withColumn("kind", F.lit(WORD))
    summed = many.join(entries.select("kind", "key", "id", "n_tokens", "tf"), ["kind", "key"]).groupBy(F.lit(SUMMED).alias("kind"), F.col("prefix").alias("key"), "id", "n_tokens").agg(F.sum("tf").alias("tf"))
    summed = stored(_with_blocks(summed), "summed")
    begun = F.length("prefix") <= HEAD
    kind = F.when(begun, BEGUN).when(F.col("n") > 1, SUMMED).otherwise(WORD)
    key = F.when(begun | (F.col("n") > 1), F.col("prefix")).otherwise(F.col("only"))
    return asked.join(counted, "prefix", "left").withColumns({"kind": kind, "key": key}).drop("n", "only"), entries.unionByName(summed), blocks.unionByName(maxima(summed))


def _scored(cells: DataFrame, entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, id, bm25 of the documents that the cells hold for all terms."""
    rows = cells.join(entries, ["kind", "key", "len_class", "tf_class"])
    whole = rows.groupBy("query_id", "wanted", "id").agg(F.count("*").alias("n_terms"), F.sum(_part(F.col("tf"), F.col("n_tokens"))).alias("bm25")).filter("n_terms = wanted")
    return whole.select("query_id", "id", "bm25").join(catalog.select("id"), "id", "left_semi")


def _top(rows: DataFrame, most: int) -> DataFrame:
    """The best rows of each query with rank (from 0); each partition passes on its own best alone."""
    w = Window.partitionBy("query_id").orderBy(F.round("bm25", 9).desc(), "id")  # sums in another order aren't another score
    return rows.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < most)


def best(queries: DataFrame, entries: DataFrame, blocks: DataFrame, counts: DataFrame, stats: DataFrame, post: DataFrame, catalog: DataFrame, most: int = MAX_CONTENT) -> tuple[DataFrame, DataFrame]:
    """(hits, cost): hits as search.content_hits gives them; cost has query_id, rows and rows_read, those of its terms' lists and those that were read for the result.

    entries, blocks, counts: of lists(), maxima() and prefix_counts(), stored; stats, post: of index.doc_stats() and index.postings(); catalog: the documents that may be hits.
    """
    plain = F.exists("terms", lambda t: (F.length(t) < 2) | (F.size(words(folded(t))) != 1) | (F.length(F.get(words(folded(t)), 0)) < 2))
    asked, entries, blocks = _found_lists(stored(_asked(queries.filter(~plain), counts, stats), "asked"), entries, blocks)
    parts = asked.join(blocks, ["kind", "key"]).withColumn("part", _part(F.col("most_tf"), F.col("least_len")))
    tops = parts.groupBy("query_id", "wanted", "len_class", "term").agg(F.max("part").alias("top"))
    together = tops.groupBy("query_id", "wanted", "len_class").agg(F.sum("top").alias("all"), F.count("*").alias("n_terms")).filter("n_terms = wanted").select("query_id", "len_class", "all")
    cells = parts.join(tops.drop("wanted"), ["query_id", "len_class", "term"]).join(together, ["query_id", "len_class"])
    cells = stored(cells.withColumn("bound", F.round(F.col("all") - F.col("top") + F.col("part"), 9) + 1e-9).drop("all", "top", "part"), "cells")

    # The rarest term's rows, from the highest bounds down, until they should hold enough documents with the other terms too.
    share = F.col("df") / F.col("n_docs")
    rare = asked.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.exp(F.sum(F.ln(share))).alias("joint"), F.min(share).alias("rarest"))
    highest = cells.groupBy("query_id").agg(F.max("bound").alias("highest"))
    cells = cells.join(highest, "query_id").withColumn("level", F.floor(F.col("bound") / F.col("highest") * LEVELS).cast("int")).drop("highest")
    above = Window.partitionBy("query_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each level
    levels = cells.join(rare, ["query_id", "term"]).groupBy("query_id", "level").agg(F.sum(F.col("n") * F.col("joint") / F.col("rarest")).alias("n"))
    cut = levels.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0.0))).filter(F.col("above") < FIRST * most).groupBy("query_id").agg(F.min("level").alias("cut"))
    cells = stored(cells.join(cut, "query_id"), "levels")
    first = _top(_scored(cells.filter("level >= cut"), entries, catalog), most)
    reached = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min(F.round("bm25", 9)).alias("least")).filter(F.col("found") == most)
    cells = stored(cells.join(reached.select("query_id", "least"), "query_id", "left").withColumn("may", F.col("least").isNull() | (F.col("bound") >= F.col("least"))), "bounded")
    rows = _top(_scored(cells.filter("may"), entries, catalog), most)
    hits = rows.select("query_id", "id", "bm25", "rank", F.count("*").over(Window.partitionBy("query_id")).alias("n"))
    cost = cells.groupBy("query_id").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("may"), F.col("n")).otherwise(0)).alias("rows_read"))
    others = queries.filter(plain & F.forall("terms", lambda t: F.length(t) >= 2))  # content_hits leaves out the rest
    return (hits if others.isEmpty() else hits.unionByName(content_hits(others, post, stats, catalog))), cost
