"""Ranked search for a table of queries at once: names and folders, contents, and names with typos.

Every stage is keyed by query_id. Names are met by trigram: a query is joined with the catalog on the rarest of its terms' trigrams and verified; a query none of whose
terms has three characters is joined on its longest term, of one or two. Contents are met through postings: whole words are joined by token, prefixes are expanded over the vocabulary
first (joined on their first three characters). Positions are looked at for phrases only. User input is never read as a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import stem
from ..functions.text import DAY_MS, allowed_typos, deletions, edit_match, folded, let, similarity, terms, trigrams, within_typos, words
from ..sources.work import few, large, stored
from .index import corpus_stats, name_grams, name_words, short_grams

EXACT_BASE, CONTENT_BASE, BOTH_BONUS = 50.0, 25.0, 10.0
MAX_CONTENT, FUZZY_BELOW, FUZZY_CHARS, MIN_SIMILARITY = 300, 5, 4, 0.75
K1, B = 1.2, 0.75
SNIPPET_TOKENS, HEAD = 14, 3
NAME_WEIGHT = 10


def parsed(queries: DataFrame) -> DataFrame:
    """query_id, terms, phrase of queries (query_id, text) that have a term."""
    return queries.select("query_id", terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0).withColumn("phrase", F.array_join("terms", " "))


#: Rows of a result that one task makes where a text's hits are dealt to the queries that ask for it, about.
DEALT = 2_000_000


def each_once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries (of parsed()) of different terms, named by the smallest query_id, stored; and query_id, of: which of them each query is, stored."""
    first = queries.groupBy("terms", "phrase").agg(F.min("query_id").alias("query_id"))
    texts, are_few = few(first.filter("query_id IS NOT NULL").select("query_id", "terms", "phrase"), "texts")
    of = texts.select(F.col("query_id").alias("of"), "terms")
    of = queries.filter("query_id IS NOT NULL").select("query_id", "terms").join(of if are_few else large(of), "terms").select("query_id", "of")
    return texts, stored(of, "same-texts")


def for_each(hits: DataFrame, same: DataFrame) -> DataFrame:
    """hits (query_id, ...) of the texts of each_once() for all queries (same). The result grows with queries times hits of a text, so a text's queries are dealt in parts of about DEALT rows, each with a copy of its hits."""
    hits = stored(hits.withColumnRenamed("query_id", "of"), "text-hits")
    asking = same.groupBy("of").agg(F.count("*").alias("n_queries")).join(hits.groupBy("of").agg(F.count("*").alias("n_hits")), "of")
    parts = stored(asking.select("of", (F.col("n_queries") * F.col("n_hits")).alias("rows")).withColumn("parts", F.ceil(F.col("rows") / DEALT).cast("int")), "parts")
    rows = parts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # These tables are small and their product isn't: without a number of partitions, Spark would put them together in a few tasks.
    tasks = int(min(10_000, max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // DEALT)))
    left = hits.join(parts.drop("rows"), "of").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").repartition(tasks, "of", "part")
    right = same.join(parts.drop("rows"), "of").select("query_id", "of", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")).repartition(tasks, "of", "part")
    return left.hint("shuffle_hash").join(right, ["of", "part"]).select("query_id", *[c for c in hits.columns if c != "of"])


def exact_score(query_terms: Column, phrase: Column, name: Column, folder: Column) -> Column:
    """Relevance of a name (lower case) and folder; null if a term is in neither. Positions count bytes before the first occurrence: a word starts after anything but an ASCII letter or digit."""

    def term_score(t: Column) -> Column:
        at = F.instr(name, t)
        before = F.substring(name, at - 1, F.lit(1))
        starts = (at == 1) | ~F.rlike(before, F.lit("^[0-9A-Za-z]$"))
        return F.when(at > 0, F.when(starts, 13.0).otherwise(8.0)).when(F.contains(folder, t), 3.0)

    each = F.aggregate(F.transform(query_terms, term_score), F.lit(0.0), lambda a, x: a + x)
    all_in_name = F.forall(query_terms, lambda t: F.contains(name, t))
    whole = F.when(stem(name) == phrase, 100.0).when(F.startswith(stem(name), phrase), 60.0).when(F.contains(name, phrase), 40.0).when(all_in_name, 25.0).otherwise(0.0)
    return each + whole - F.least(F.octet_length(name) / 20.0, F.lit(5.0))


def boost(now_ms: int) -> Column:
    """For recent changes, favourites, number of opens and a recent open, of the catalog's columns."""
    days = F.expr(f"({now_ms} - modified_at) div {DAY_MS}")
    recent = F.when(days <= 7, 8.0).when(days <= 30, 5.0).when(days <= 365, 2.0).otherwise(0.0)
    opened = F.expr(f"({now_ms} - last_opened_at) div {DAY_MS}")
    return F.coalesce(recent, F.lit(0.0)) + F.when(F.col("is_favourite"), 15.0).otherwise(0.0) + F.least(F.col("open_count"), F.lit(10)) * 1.5 + F.when(opened < 7, 5.0).otherwise(0.0)


def candidates(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id and id of documents that hold every term in name or folder. queries: of parsed(). Few queries are sent to the names; many meet the names' trigrams by a shuffle."""
    both = F.concat(F.lower("name"), F.lit("\n"), F.lower("dir"))
    rows = catalog.select("id", F.lower("name").alias("lname"), F.lower("dir").alias("ldir"))
    long = F.filter("terms", lambda t: F.length(t) >= 3)
    wanted = queries.filter(F.size(long) > 0).select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(long, trigrams)))).alias("gram"))
    asked, are_few = few(wanted.select("gram").distinct(), "asked-grams")
    grams = name_grams(catalog, both) if are_few else stored(name_grams(catalog, both), "path-grams")
    counts = grams.join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    every = F.forall("terms", lambda t: F.contains(F.col("lname"), t) | F.contains(F.col("ldir"), t))
    met, are_few = few(queries.join(rarest, "query_id"), "rarest")
    if are_few:
        each = rows.select("*", F.explode(trigrams(F.concat("lname", F.lit("\n"), "ldir"))).alias("gram"))
        by_gram = each.join(met, "gram").filter(every)
    else:
        by_gram = met.join(large(grams), "gram").join(large(rows), "id").filter(every)
    no_long = queries.filter(F.size(long) == 0)
    if no_long.isEmpty():
        return by_gram.select("query_id", "id")
    longest = F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("gram"))))["gram"]
    asked, _ = few(no_long.withColumn("gram", longest), "short")
    short = asked.join(large(short_grams(catalog, both)), "gram").join(large(rows), "id").filter(every)
    return by_gram.select("query_id", "id").unionByName(short.select("query_id", "id"))


def exact_hits(queries: DataFrame, catalog: DataFrame, now_ms: int) -> DataFrame:
    """query_id, id, score."""
    found = candidates(queries, catalog).join(few(queries, "queries")[0], "query_id").join(large(catalog), "id")
    score = F.lit(EXACT_BASE) + exact_score(F.col("terms"), F.col("phrase"), F.lower("name"), F.lower("dir")) + boost(now_ms)
    return found.select("query_id", "id", score.alias("score"))


def capped(hits: DataFrame, catalog: DataFrame, most: int = 2000) -> DataFrame:
    """Optional: the newest candidates of each query."""
    w = Window.partitionBy("query_id").orderBy(F.col("modified_at").desc_nulls_last(), "id")
    return hits.join(large(catalog.select("id", "modified_at")), "id").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select("query_id", "id")


def name_bm25(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, id, bm25 of names and folders that hold all of a query's terms, for queries whose terms all have three characters or more: an occurrence in a name weighs NAME_WEIGHT times one in a
    folder, lengths are numbers of trigrams. A term's frequency is counted over all documents that hold it."""
    each = queries.filter(F.forall("terms", lambda t: F.length(t) >= 3)).select("query_id", F.size("terms").alias("wanted"), F.posexplode("terms").alias("term", "word"))
    words_ = each.select("word").distinct().select(F.col("word").alias("query_id"), F.array("word").alias("terms"))  # each distinct word is looked for once
    places = lambda text, t: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.length(t)) == t))
    grams = lambda text: F.greatest(F.length(text) - 2, F.lit(0))
    rows = catalog.select("id", F.lower("name").alias("lname"), F.lower("dir").alias("ldir"))
    tf = NAME_WEIGHT * places(F.col("lname"), F.col("word")) + places(F.col("ldir"), F.col("word"))
    hits = candidates(words_, catalog).withColumnRenamed("query_id", "word").join(large(rows), "id").select("word", "id", tf.alias("tf"))
    lengths = rows.select("id", (grams(F.col("lname")) + grams(F.col("ldir"))).alias("n_tokens"))
    found = bm25(each.join(large(hits), "word").select("query_id", "term", "id", "tf"), lengths)
    return found.join(few(each.select("query_id", "wanted").distinct(), "wanted")[0], "query_id").filter("n_terms = wanted").select("query_id", "id", "bm25")


def capped_by_weight(queries: DataFrame, hits: DataFrame, catalog: DataFrame, most: int = 2000) -> DataFrame:
    """Optional: query_id, id, bm25, n (from 1) of the best candidates of each query by name_bm25(), ties newest first; where a term is shorter than three characters all are ties (bm25 null)."""
    weighed = hits.join(large(name_bm25(queries, catalog)), ["query_id", "id"], "left").join(large(catalog.select("id", "modified_at")), "id")
    w = Window.partitionBy("query_id").orderBy(F.round("bm25", 9).desc_nulls_last(), F.col("modified_at").desc_nulls_last(), "id")
    return weighed.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("query_id", "id", "bm25", "n")


def content_matches(queries: DataFrame, post: DataFrame) -> DataFrame:
    """query_id, term, id, tf: where each term occurs; a term of several tokens is a phrase, its last token a prefix. Queries with a term of one character are left out."""
    usable = queries.filter(F.forall("terms", lambda t: F.length(t) >= 2))
    each = usable.select("query_id", F.posexplode("terms").alias("term", "text")).withColumn("tokens", words(folded(F.col("text")))).filter(F.size("tokens") > 0)
    single = few(each.filter(F.size("tokens") == 1).select("query_id", "term", F.col("tokens")[0].alias("begin")), "single")[0]
    found = single.join(large(begun_by(single.select("begin").distinct(), post)), "begin").select("query_id", "term", "id", "tf")
    several = each.filter(F.size("tokens") > 1)
    return found if several.isEmpty() else found.unionByName(phrases(several, post))


def vocabulary_of(post: DataFrame) -> DataFrame:
    """token, head: the distinct tokens with their first one to HEAD characters."""
    return post.select("token").distinct().select("token", F.explode(_heads("token")).alias("head"))


def _heads(c: str) -> Column:
    return F.array_distinct(F.array(*[F.substring(c, 1, k) for k in range(1, HEAD + 1)]))


#: Up to so many beginnings meet the postings by their heads; of more, each posting would be compared with many.
HEADS = 2_000


def begun_by(asked: DataFrame, post: DataFrame) -> DataFrame:
    """begin, id, tf: how often a document's tokens begin with each of asked (begin, each once), stored. Up to HEADS are sent to the postings; more are expanded over the vocabulary first, as many share a head."""
    asked, _ = few(asked.withColumn("head", F.substring("begin", 1, HEAD)), "asked")
    if asked.count() <= HEADS:
        met = post.select("token", "id", "tf", F.explode(_heads("token")).alias("head")).join(F.broadcast(asked), "head").filter(F.startswith("token", F.col("begin")))
    else:
        words_, are_few = few(asked.join(large(vocabulary_of(post)), "head").filter(F.startswith("token", F.col("begin"))).select("begin", "token"), "begun-words")
        met = post.select("token", "id", "tf").join(words_ if are_few else large(words_), "token")
    return stored(met.groupBy("begin", "id").agg(F.sum("tf").alias("tf")), "begun")


def phrases(each: DataFrame, post: DataFrame) -> DataFrame:
    """query_id, term, id, tf of terms (query_id, term, tokens) of several tokens."""
    slots = each.select("query_id", "term", F.size("tokens").alias("length"), F.posexplode("tokens").alias("slot", "wanted"))
    slots, _ = few(slots.withColumn("is_prefix", F.col("slot") == F.col("length") - 1), "slots")
    columns = ("query_id", "term", "length", "slot")
    whole = slots.filter("NOT is_prefix").select(*columns, F.col("wanted").alias("token"))
    begun = slots.filter("is_prefix").withColumn("head", F.substring("wanted", 1, HEAD)).join(vocabulary_of(post), "head").filter(F.startswith("token", F.col("wanted"))).select(*columns, "token")
    tokens, _ = few(whole.unionByName(begun), "phrase-tokens")
    places = post.join(tokens, "token").select("query_id", "term", "id", "length", "slot", F.explode("positions").alias("pos"))
    starts = places.groupBy("query_id", "term", "id", "length", (F.col("pos") - F.col("slot")).alias("at")).agg(F.count_distinct("slot").alias("n")).filter("n = length")
    return starts.groupBy("query_id", "term", "id").agg(F.count("*").alias("tf"))


def bm25(matches: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, id, n_terms, bm25: the sum over a query's terms of idf by saturated frequency. stats: id, n_tokens of all texts."""
    df = few(matches.groupBy("query_id", "term").agg(F.count("*").alias("df")), "df")[0]
    corpus = F.broadcast(corpus_stats(stats))  # one row
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_tokens"))
    rows = matches.join(df, ["query_id", "term"]).join(large(stats), "id").crossJoin(corpus).select("query_id", "id", (idf * F.col("tf") * (K1 + 1) / norm).alias("part"))
    return rows.groupBy("query_id", "id").agg(F.count("*").alias("n_terms"), F.sum("part").alias("bm25"))


def content_hits(queries: DataFrame, post: DataFrame, stats: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, id, rank (from 0), n: documents whose text has all terms, best first, at most 300. The corpus' figures are over all texts, hits within catalog."""
    wanted = few(queries.select("query_id", F.size("terms").alias("wanted")), "wanted")[0]
    ranked = bm25(content_matches(queries, post), stats).join(wanted, "query_id").filter("n_terms = wanted").join(large(catalog.select("id")), "id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.round("bm25", 9).desc(), "id")  # sums in another order aren't another score
    best = ranked.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < MAX_CONTENT)
    return best.select("query_id", "id", "bm25", "rank", F.count("*").over(Window.partitionBy("query_id")).alias("n"))


def merged(exact: DataFrame, content: DataFrame, catalog: DataFrame, now_ms: int) -> DataFrame:
    """query_id, id, score, in_text."""
    both = exact.join(content.select("query_id", "id", "rank", "n"), ["query_id", "id"], "full_outer").join(large(catalog.select("id", boost(now_ms).alias("boost"))), "id")
    text_only = F.lit(CONTENT_BASE) + 10.0 * (1.0 - F.col("rank") / F.greatest("n", F.lit(1))) + F.col("boost")
    score = F.when(F.col("score").isNull(), text_only).when(F.col("rank").isNotNull(), F.col("score") + BOTH_BONUS).otherwise(F.col("score"))
    return both.select("query_id", "id", score.alias("score"), F.col("rank").isNotNull().alias("in_text"))


def needy(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries of four characters or more with fewer than five hits."""
    count = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    return queries.join(count, "query_id", "left").filter((F.coalesce("n_hits", F.lit(0)) < FUZZY_BELOW) & (F.length("phrase") >= FUZZY_CHARS)).drop("n_hits")


def near_words(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, word: the words (word, each once) within a term's typos. They meet in what is left of both without as many characters; only words of about a term's length are looked at. asked: column term, each once."""
    budget = allowed_typos(F.col("term"))
    out = None
    for k in (1, 2):
        own, _ = few(asked.filter(budget == k).select("term", F.explode(deletions(F.col("term"), k)).alias("rest")), "rests")
        lengths, _ = few(own.select(F.explode(F.sequence(F.length("term") - k, F.length("term") + k)).alias("length")).distinct(), "lengths")
        some = vocabulary.withColumn("length", F.length("word")).join(lengths, "length", "left_semi").select("word", F.explode(deletions(F.col("word"), k)).alias("rest"))
        pairs = own.join(large(some), "rest").select("term", "word").distinct()
        pairs = pairs.filter(within_typos(F.col("term"), F.col("word")).isNotNull())
        out = pairs if out is None else out.unionByName(pairs)
    return out


def typo_candidates(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, id of names that may match a query with typos. queries: with grams, the trigrams of the phrase without spaces.

    A name that has three quarters of the trigrams has one of the rarest quarter (and one more). A name within the typos of all terms holds the longest term, and so its rarest trigram, or has
    a word within its typos. Where no term has three characters, any trigram will do.
    """
    grams = stored(name_grams(catalog, F.lower("name")), "name-grams")
    each = queries.withColumn("longest", F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"])
    own = each.select("query_id", F.explode("grams").alias("gram"), F.lit(False).alias("of_term")).unionByName(each.select("query_id", F.explode(trigrams(F.col("longest"))).alias("gram"), F.lit(True).alias("of_term")))
    counts = grams.join(few(own.select("gram").distinct(), "own-grams")[0], "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    listed = own.join(counts, "gram", "left").groupBy("query_id", "of_term").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("grams"))  # a query's trigrams
    spare = F.size("grams") - F.ceil(F.size("grams") * MIN_SIMILARITY).cast("int") + 1
    no_long = each.filter(F.length("longest") < 3).select("query_id")
    rare = listed.join(no_long.withColumn("all", F.lit(True)), "query_id", "left").select("query_id", F.explode(F.slice("grams", 1, F.when(F.col("all"), F.size("grams")).when(F.col("of_term"), 1).otherwise(spare))).alias("x")).select("query_id", "x.gram").distinct()
    by_gram = few(rare, "rare")[0].join(large(grams), "gram").select("query_id", "id")
    by_word = name_words(catalog)
    near = near_words(each.select(F.col("longest").alias("term")).distinct(), by_word.select("word").distinct())
    alike, _ = few(each.select("query_id", F.col("longest").alias("term")).join(near, "term").select("query_id", "word"), "near-words")
    by_typo = alike.join(large(by_word), "word").select("query_id", "id")
    return by_gram.unionByName(by_typo).distinct()


def fuzzy_hits(queries: DataFrame, catalog: DataFrame, now_ms: int) -> DataFrame:
    """query_id, id, score of names that share a trigram with a query and are within its typos, or alike."""
    q, _ = few(queries.withColumn("grams", trigrams(F.replace("phrase", F.lit(" "), F.lit("")))), "needy")  # read several times, and made of all hits
    rows = typo_candidates(q, catalog).join(q, "query_id").join(large(catalog), "id").withColumn("lname", F.lower("name"))
    alike = similarity(F.col("grams"), F.col("lname"))
    score = F.coalesce(edit_match(F.col("terms"), F.col("lname")), F.when(alike >= MIN_SIMILARITY, 12.0 * alike))
    return rows.filter(alike > 0).withColumn("base", score).filter("base IS NOT NULL").select("query_id", "id", (F.col("base") + boost(now_ms)).alias("score"))


def all_hits(queries: DataFrame, catalog: DataFrame, post: DataFrame, stats: DataFrame, now_ms: int) -> DataFrame:
    """query_id, id, score, in_text of all three stages; the first two are stored, as the third depends on their number. queries: of parsed()."""
    found = stored(merged(exact_hits(queries, catalog, now_ms), content_hits(queries, post, stats, catalog), catalog, now_ms), "found")
    more = fuzzy_hits(needy(queries, found), catalog, now_ms).join(large(found.select("query_id", "id")), ["query_id", "id"], "left_anti")
    return found.unionByName(more.withColumn("in_text", F.lit(False)))


def ranked(hits: DataFrame, catalog: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of each query: rank (from 1), total before paging. Score falling, then newest, then id."""
    q = Window.partitionBy("query_id")
    order = q.orderBy(F.col("score").desc(), F.col("modified_at").desc_nulls_last(), "id")
    rows = hits.join(large(catalog.select("id", "name", "modified_at")), "id").withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(q))
    start = max(0, offset)
    return rows.filter((F.col("rank") > start) & (F.col("rank") <= start + min(1000, max(1, limit))))


def search(queries: DataFrame, catalog: DataFrame, post: DataFrame, stats: DataFrame, now_ms: int, limit: int = 200, offset: int = 0) -> DataFrame:
    """queries (query_id, text) against a catalog, which may be filtered by any view first."""
    return ranked(all_hits(parsed(queries), catalog, post, stats, now_ms), catalog, limit, offset)


def snippet(body: Column, query_terms: Column) -> Column:
    """At most 14 words around the matches, hits between U+0002 and U+0003, … where text is cut. Of windows that begin with a hit: most distinct terms, then most hits, then the earliest."""
    wanted = F.array_distinct(F.flatten(F.transform(query_terms, lambda t: words(folded(t)))))
    parts = F.struct(F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("kept"), F.split(body, r"[\p{L}\p{N}]+", -1).alias("gaps"), wanted.alias("wanted"))

    def found(p: Column) -> Column:
        hits = F.transform(p["kept"], lambda w: F.filter(p["wanted"], lambda t: F.startswith(folded(w), t)))
        return let(F.struct(p["kept"].alias("kept"), p["gaps"].alias("gaps"), hits.alias("hits"), F.size(p["kept"]).alias("n")), windows)

    def windows(p: Column) -> Column:
        last = F.greatest(p["n"] - SNIPPET_TOKENS, F.lit(0))
        begins = F.array_distinct(F.filter(F.transform(p["hits"], lambda h, i: F.when(F.size(h) > 0, F.least(i, last))), lambda i: i.isNotNull()))
        inside = lambda i: F.slice(p["hits"], i + 1, SNIPPET_TOKENS)
        best = F.array_max(F.transform(begins, lambda i: F.struct(F.size(F.array_distinct(F.flatten(inside(i)))).alias("terms"), F.size(F.filter(inside(i), lambda h: F.size(h) > 0)).alias("hits"), (-i).alias("before"))))
        return let(F.struct(*[p[c].alias(c) for c in ("kept", "gaps", "hits", "n")], (-best["before"]).alias("start")), shown)

    def shown(p: Column) -> Column:
        stop = F.least(p["start"] + SNIPPET_TOKENS, p["n"])
        word = lambda i: F.when(F.size(F.get(p["hits"], i)) > 0, F.concat(F.lit("\u0002"), F.get(p["kept"], i), F.lit("\u0003"))).otherwise(F.get(p["kept"], i))
        marked = F.transform(F.sequence(p["start"], stop - 1), lambda i: F.concat(word(i), F.when(i < stop - 1, F.get(p["gaps"], i + 1)).otherwise("")))
        return F.when(p["start"].isNotNull(), F.concat(F.when(p["start"] > 0, "…").otherwise(""), F.array_join(marked, ""), F.when(stop < p["n"], "…").otherwise("")))

    return let(parts, found)


def with_snippets(page: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """page (query_id, id, in_text, ...) with snippet. Texts are joined for the page's rows alone. queries: of parsed()."""
    page = stored(page, "page")
    bodies = few(page.filter("in_text").select("query_id", "id"), "page-ids")[0].join(texts, "id").join(queries.select("query_id", "terms"), "query_id")
    return page.join(bodies.select("query_id", "id", snippet(F.col("body"), F.col("terms")).alias("snippet")), ["query_id", "id"], "left")


def launcher(queries: DataFrame, catalog: DataFrame, post: DataFrame, stats: DataFrame, now_ms: int, most: int = 7) -> DataFrame:
    """query_id, rank, id: the best hits; for queries without a term the last opened documents, or the last changed ones where none was opened."""
    asked = parsed(queries)
    blank = queries.join(asked.select("query_id"), "query_id", "left_anti").select("query_id")
    opened = catalog.filter("last_opened_at IS NOT NULL").orderBy(F.desc("last_opened_at"), "id").limit(most).select("id", F.col("last_opened_at").alias("at"), F.lit(1).alias("kind"))
    changed = catalog.orderBy(F.col("modified_at").desc_nulls_last(), "id").limit(most).select("id", F.col("modified_at").alias("at"), F.lit(0).alias("kind"))
    shown = opened.unionByName(changed).withColumn("best", F.max("kind").over(Window.partitionBy())).filter("kind = best")  # twice `most` rows
    nth = shown.select("id", F.row_number().over(Window.orderBy(F.col("at").desc_nulls_last(), "id")).alias("rank"))
    shown = blank.crossJoin(F.broadcast(nth)).select("query_id", "rank", "id")  # `most` rows
    if asked.isEmpty():  # no stage of a search has anything to do
        return shown
    return search(queries, catalog, post, stats, now_ms, most).select("query_id", "rank", "id").unionByName(shown)
